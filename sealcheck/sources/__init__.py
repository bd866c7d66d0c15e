"""Readers and writers. A root folder holds one folder per snapshot."""
