"""Language-model scores from Elias-Fano n-gram tries (operator 9)."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sealcheck.llm.common import held_out, row_key
from sealcheck.llm.words import mix, word_hashes

CHUNK_BYTES = 8 << 20
WEIGHT = 0.7
SPREAD = 16
GRID = 4096
BEGIN, END = np.uint64(0x6265_6769_6E00_0001), np.uint64(0x656E_6400_0000_0003)


class EliasFano:
    """A file of non-decreasing numbers: low bits packed, high bits in unary. Opened as a memory map.

    With n numbers below u the low part of a number has log2(u/n) bits; number i with high part h sets bit h + i.
    """

    def __init__(self, path: str):
        self.size, self.width, low = (int(x) for x in np.fromfile(path, np.int64, 3))
        raw = np.memmap(path, np.uint8, "r", 24)
        self.low, bits = raw[:low], raw[low:]
        self.ones = np.flatnonzero(np.unpackbits(bits)) if self.size else np.zeros(0, np.int64)
        self.high = self.ones - np.arange(self.size)

    @staticmethod
    def write(path: str, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        low = np.zeros((n, width), np.uint8)
        for b in range(width):
            low[:, b] = (values >> np.uint64(width - 1 - b)).astype(np.uint8) & 1
        low = np.concatenate([np.packbits(low.ravel()), np.zeros(16, np.uint8)])
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(int(high[-1]) + n if n else 0, np.uint8)
        bits[high + np.arange(n)] = 1
        with open(path, "wb") as file:
            file.write(np.array([n, width, len(low)], np.int64).tobytes() + low.tobytes() + np.packbits(bits).tobytes() + b"\0" * 8)
        return EliasFano(path)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The packed low bits of numbers i: nine bytes hold them wherever they start."""
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | self.low[byte + k].astype(np.uint64)
        word = (word << shift) | (self.low[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift))
        return word >> np.uint64(64 - self.width)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number not below x within [first, last): its bucket of high bits, then by halves."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        lo = np.maximum(np.searchsorted(self.high, high, "left"), first)
        hi = np.searchsorted(self.high, high, "right")
        hi = np.maximum(hi if last is None else np.minimum(hi, last), lo)
        want = x & np.uint64((1 << self.width) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = self._low(mid) < want[live]
            lo[live], hi[live] = np.where(below, mid + 1, lo[live]), np.where(below, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of x, and whether it is there."""
        at = self.successor(x)
        ok = at < self.size
        if self.size:
            ok &= self.get(np.minimum(at, self.size - 1)) == x
        return np.where(ok, at, 0), ok


class Trie:
    """One shard of the model: words with their counts, and contexts with the words that follow them.

    Level one holds words and, as running totals, their counts. Level two holds contexts, pointers to the ranges
    of their successors, the successors raised by the context's place so that all ranges together rise, and per
    successor a logarithm of its count on a grid of 1/4096.
    """

    def __init__(self, folder: str, words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray, pairs: np.ndarray):
        path = lambda name: os.path.join(folder, name)
        self.words = EliasFano.write(path("words"), words)
        self.totals = EliasFano.write(path("totals"), np.concatenate([[0], np.cumsum(counts)]))
        self.contexts = EliasFano.write(path("contexts"), contexts)
        self.pointers = EliasFano.write(path("pointers"), np.concatenate([[0], np.cumsum(lengths)]))
        self.next = EliasFano.write(path("next"), (np.repeat(np.arange(len(contexts), dtype=np.uint64), lengths) << np.uint64(32)) | successors)
        np.round(np.log10(np.maximum(pairs, 1)) * GRID).astype(np.uint16).tofile(path("codes"))
        self.codes = np.memmap(path("codes"), np.uint16, "r") if len(pairs) else np.zeros(0, np.uint16)

    def count(self, words: np.ndarray) -> np.ndarray:
        at, ok = self.words.find(words)
        return np.where(ok, (self.totals.get(at + 1) - self.totals.get(at)).astype(np.int64), 0) if self.words.size else np.zeros(len(words), np.int64)

    def follow(self, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes, one higher, of successors asked for context by context; 0 where there is none."""
        out = np.zeros(len(successors), np.uint16)
        if not self.contexts.size:
            return out
        at, ok = self.contexts.find(contexts)
        first, last = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        first, last, at, ok = (np.repeat(v, lengths) for v in (first, last, at, ok))
        want = (at.astype(np.uint64) << np.uint64(32)) | successors
        place = np.minimum(self.next.successor(want, first, last), self.next.size - 1)
        ok &= (place < last) & (self.next.get(place) == want)
        out[ok] = self.codes[place[ok]] + np.uint16(1)
        return out


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 up, as many bytes each as the largest needs: all lowest bytes first, so the high ones, nearly all 0, lie together."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(numbers) else b""


def _unpack(raw: bytes, size: int, kind: type) -> np.ndarray:
    """What `_pack` made of `size` numbers."""
    numbers = np.zeros((size, 8), np.uint8)
    if size:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, size)
        numbers[:, :len(planes)] = planes.T
    return numbers.view("<u8").ravel().astype(kind)


def _total(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _ranges(present: np.ndarray, shard: np.ndarray) -> list[tuple[int, int]]:
    """Where each shard that is present lies in a sorted array of shards."""
    return list(zip(np.searchsorted(shard, present, "left").tolist(), np.searchsorted(shard, present, "right").tolist()))


class Chunk:
    """The tokens of some documents: every word once, every pair of a context and a word once, both in shard order."""

    def __init__(self, texts: Iterator[str], learn: np.ndarray, shards: int):
        found = [np.concatenate([word_hashes(t.encode("utf-8", "surrogatepass"))[0], [END]]) for t in texts]
        self.sizes = np.array([len(f) for f in found], np.int64)
        tokens = np.concatenate(found)
        before = np.concatenate([[BEGIN], tokens[:-1]])
        before[np.cumsum(self.sizes)[:-1]] = BEGIN
        learned = np.repeat(learn, self.sizes)
        words, self.word = np.unique(np.concatenate([[BEGIN], tokens]), return_inverse=True)
        begin, self.word = self.word[0], self.word[1:]
        counts = np.bincount(self.word[learned], minlength=len(words))
        counts[begin] = int(learn.sum())
        shard = (mix(words) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.words, self.counts, self.shard = words[order], counts[order], shard[order]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.context = place[np.searchsorted(words, before)]
        pair, self.pair = np.unique(np.searchsorted(words, before) * len(words) + self.word, return_inverse=True)
        self.word = place[self.word]
        counts = np.bincount(self.pair[learned], minlength=len(pair))
        context, word = words[pair // len(words)], words[pair % len(words)]
        # A context's successors are spread over some shards, so a frequent word does not fill one.
        shard = ((mix(context) % np.uint64(shards) + (word % np.uint64(SPREAD))) % np.uint64(shards)).astype(np.int64)
        following = word >> np.uint64(32)
        order = np.lexsort((following, context, shard))
        place = np.empty(len(pair), np.int64)
        place[order] = np.arange(len(pair))
        self.pair = place[self.pair]
        self.contexts, self.following, self.pairs, self.pair_shard = context[order], following[order], counts[order], shard[order]

    def messages(self, chunk: int) -> pd.DataFrame:
        out = []
        present = np.union1d(self.shard, self.pair_shard)
        for s, (a, b), (c, d) in zip(present.tolist(), _ranges(present, self.shard), _ranges(present, self.pair_shard)):
            context = self.contexts[c:d]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if d > c else np.zeros(0, int)
            out.append((s, chunk, self.words[a:b].tobytes(), _pack(self.counts[a:b]), context[first].tobytes(),
                        _pack(np.diff(np.concatenate([first, [d - c]]))) if d > c else b"",
                        self.following[c:d].astype(np.uint32).tobytes(), _pack(self.pairs[c:d])))
        return pd.DataFrame(out, columns=["shard", "chunk", "words", "counts", "contexts", "lengths", "following", "pairs"])


MESSAGE = "shard long, chunk long, words binary, counts binary, contexts binary, lengths binary, following binary, pairs binary"


def _vocabulary(shards: int):
    """Per batch and shard, the words learned from and their counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"][~batch["held"].astype(bool)]
            if not len(texts):
                continue
            found = np.concatenate([h for t in texts for h in (word_hashes(t.encode("utf-8", "surrogatepass"))[0], [END])])
            words, counts = np.unique(found, return_counts=True)
            shard = (mix(words) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            words, counts, shard = words[order], counts[order], shard[order]
            present = np.unique(shard)
            yield pd.DataFrame([(s, words[a:b].tobytes(), _pack(counts[a:b])) for s, (a, b) in zip(present.tolist(), _ranges(present, shard))],
                               columns=["shard", "words", "counts"])
    return run


def _tally(group: pd.DataFrame) -> pd.DataFrame:
    words = np.concatenate([np.frombuffer(x, np.uint64) for x in group["words"]])
    counts = np.concatenate([_unpack(x, len(w) // 8, np.int64) for x, w in zip(group["counts"], group["words"])])
    return pd.DataFrame({"tokens": [int(counts.sum())], "distinct": [len(np.unique(words))]})


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Merge what all chunks counted into the shard's trie, write its levels, and look up what each chunk asked for."""
    read = lambda column, kind: [np.frombuffer(x, kind) for x in group[column]]
    unpack = lambda column, kind, beside: [_unpack(x, len(b), kind) for x, b in zip(group[column], beside)]
    words, contexts, following = read("words", np.uint64), read("contexts", np.uint64), read("following", np.uint32)
    counts, lengths, pairs = unpack("counts", np.int64, words), unpack("lengths", np.int64, contexts), unpack("pairs", np.int64, following)
    word, count = _total(np.concatenate(words), np.concatenate(counts))
    word, count = word[count > 0], count[count > 0]
    known, at = np.unique(np.concatenate(contexts), return_inverse=True)
    code = (np.repeat(at, np.concatenate(lengths)).astype(np.uint64) << np.uint64(32)) | np.concatenate(following)
    code, pair = _total(code, np.concatenate(pairs))
    code, pair = code[pair > 0], pair[pair > 0]
    owner, size = np.unique((code >> np.uint64(32)).astype(np.int64), return_counts=True)
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(folder, word, count, known[owner], size, code & np.uint64(0xFFFFFFFF), pair)
        return pd.DataFrame({"chunk": group["chunk"], "shard": group["shard"], "n_words": [len(w) for w in words], "counts": [_pack(trie.count(w)) for w in words],
                             "n_pairs": [len(f) for f in following], "codes": [_pack(trie.follow(c, n, f.astype(np.uint64))) for c, n, f in zip(contexts, lengths, following)]})


def _score(shards: int, total: int, distinct: int, weight: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        chunk = Chunk(docs["text"], ~docs["held"].to_numpy(bool), shards)
        answers = answers.sort_values("shard")
        count = np.concatenate([_unpack(x, n, np.int64) for x, n in zip(answers["counts"], answers["n_words"])])
        code = np.concatenate([_unpack(x, n, np.uint16) for x, n in zip(answers["codes"], answers["n_pairs"])])
        smooth = (count + 0.1) / (total + 0.1 * (distinct + 1))
        single, after = count[chunk.word], count[chunk.context]
        pair = code[chunk.pair].astype(float)
        joint = np.where(pair > 0, 10 ** ((pair - 1) / GRID), 0)
        follow = np.where(after > 0, weight * joint / np.maximum(after, 1), 0)
        model = np.log10(follow + np.where(after > 0, 1 - weight, 1) * smooth[chunk.word])
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "held_out": docs["held"].to_numpy(), "n_tokens": chunk.sizes,
                             "n_known": np.add.reduceat((single > 0).astype(np.int64), starts),
                             "base_score": np.add.reduceat(np.log10(smooth)[chunk.word], starts), "score": np.add.reduceat(model, starts)})
    return run


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, weight: float = WEIGHT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D with A-Z in lower case; each text ends in one more
    token. Counts come from all texts outside the held-out tenth. base_score is the additive unigram score of the
    contract. score is a bigram model: weight * c(v,w)/c(v) + (1 - weight) * p(w) with p the additive unigram, the
    whole p where v was never seen; the first word follows a begin mark. Pair counts are quantised to 1/4096 of a
    decade, single counts are exact.

    The model is never in one place. Documents are dealt into chunks of about `chunk_bytes`; a chunk sends each
    word and pair it holds once, with its counts in as few bytes as the largest needs, to one of as many shards. A shard merges them, writes its trie
    as Elias-Fano levels, and answers from the memory map. Successors are told apart by 32 bits inside their
    context. A frequent context is spread over 16 shards.

    Null text is empty: one token, the end. Equal rows are scored each and counted each. With nothing to learn
    from, every count is 0. An empty table gives no row; columns other than doc_id and text are ignored.
    """
    spread = F.xxhash64(row_key("doc_id", "text"), F.monotonically_increasing_id() % 64)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(10).alias("held"), spread.alias("spread"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(1, -(-size // chunk_bytes))
    totals = (rows.select("text", "held").mapInPandas(_vocabulary(shards), "shard long, words binary, counts binary")
              .groupBy("shard").applyInPandas(_tally, "tokens long, distinct long").agg(F.sum("tokens"), F.sum("distinct")).first())
    total, distinct = totals[0] or 0, totals[1] or 0
    placed = rows.select("doc_id", "text", "held", F.pmod("spread", F.lit(shards)).alias("chunk"))

    def send(group: pd.DataFrame) -> pd.DataFrame:
        return Chunk(group["text"], ~group["held"].to_numpy(bool), shards).messages(int(group["chunk"].iloc[0]))

    # The deal of documents to chunks is one exchange that both uses below share.
    messages = placed.groupBy("chunk").applyInPandas(send, MESSAGE)
    answers = messages.groupBy("shard").applyInPandas(_answer, "chunk long, shard long, n_words long, counts binary, n_pairs long, codes binary")
    scored = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _score(shards, total, distinct, weight), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
