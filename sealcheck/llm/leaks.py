"""Benchmark decontamination by latent semantic retrieval (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sealcheck.llm.common import KEY, row_key, whole_row
from sealcheck.llm.words import PUNCTUATION, word_hashes

PASSAGE = 32
RANK = 128
EXTRA = 16
COSINE = 0.4
MIN_TERMS = 3
PARAPHRASE = 0.6
VERBATIM = 0.8
COMMON = 0.02
BLOCK_ITEMS = 2048
BLOCK_WORDS = 200_000
SEED = 20_240_602
PIECE_BYTES = 64 << 10


def _words(text: str | None) -> np.ndarray:
    return word_hashes(text.lower().encode("utf-8", "surrogatepass"), PUNCTUATION)[0] if text else np.zeros(0, np.uint64)


def _pieces(texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, words, cuts): neighbouring texts hashed together, about 64 KiB a time; words of text first + i are words[cuts[i]:cuts[i + 1]]."""
    held: list[bytes] = []
    first, size = 0, 0
    for at, text in enumerate(texts):
        held.append(text.lower().encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1]) + 1
        if size >= PIECE_BYTES or at + 1 == len(texts):
            # A line feed parts words, so none reaches into the next text.
            hashes, starts, _ = word_hashes(b"\n".join(held), PUNCTUATION)
            yield first, hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(h) + 1 for h in held])]))
            held, first, size = [], at + 1, 0


@dataclass
class Items:
    """A block of benchmark items: their words, the terms of the latent space and, once fitted, its vectors."""
    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    vectors: np.ndarray | None = None
    latent: np.ndarray | None = None
    keys: list[np.ndarray] | None = None
    known: list[np.ndarray] | None = None
    holders: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    need: np.ndarray | None = None

    def rows(self) -> np.ndarray:
        """Items by term, 1 where the item has it."""
        out = np.zeros((len(self.ids), len(self.terms)), np.float32)
        for i, w in enumerate(self.words):
            out[i, np.searchsorted(self.terms, np.intersect1d(w, self.terms))] = 1
        return out


def blocks(benchmark: DataFrame, block_items: int, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, streamed to the driver partition by partition."""
    has_answer = "answer" in benchmark.columns
    held: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text", *(["answer"] if has_answer else [])).orderBy("item_id", "text").toLocalIterator():
        words = _words(row["text"])
        if not len(words):
            continue
        if held and (len(held) >= block_items or size + len(words) > block_words):
            yield _block(held)
            held, size = [], 0
        held.append((None if row["item_id"] is None else str(row["item_id"]), words, _words(row["answer"]) if has_answer else np.zeros(0, np.uint64)))
        size += len(words)
    if held:
        yield _block(held)


def _block(held: list[tuple]) -> Items:
    """Terms are words that stand in few items; those of many say nothing about one. An item of none but such keeps them all."""
    words = [w for _, w, _ in held]
    every, seen = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    rare = every[seen <= max(3, COMMON * len(held))]
    plain = [w for w in words if len(np.intersect1d(w, rare)) < MIN_TERMS]
    return Items([i for i, _, _ in held], words, [a for _, _, a in held], np.union1d(rare, np.concatenate(plain)) if plain else rare)


def _found(words: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, term) of the words of a text that are terms."""
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    place = np.flatnonzero(terms[at] == words)
    return place, at[place]


def _certain(words: np.ndarray, terms: np.ndarray, passage: int) -> int:
    """How many terms of an item stand together in some window of a text, wherever in the text a copy of the item begins."""
    place, term = _found(words, terms)
    step, least = passage // 2, len(words)
    for offset in range(step):
        window = (place + offset) // step
        pair = np.unique(np.concatenate([window, window - 1]) * len(terms) + np.concatenate([term, term]))
        least = min(least, int(np.unique(pair // len(terms), return_counts=True)[1].max(initial=0)))
    return least


def _sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of rows over equal neighbouring groups."""
    return np.add.reduceat(values, np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])), axis=0)


def _sketch(items, random, passage: int):
    """Per task: how many passages there are, how many hold each term, and A'A times the random matrix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, omega = items.value.terms, random.value
        count, df = 0, np.zeros(len(terms), np.int64)
        total = np.zeros(omega.shape, np.float64)

        def add(where: np.ndarray, term: np.ndarray) -> None:
            rows = _sums(omega[term], where)
            row = np.cumsum(np.concatenate([[0], where[1:] != where[:-1]]))
            order = np.argsort(term, kind="stable")
            total[np.unique(term)] += _sums(rows[row[order]], term[order])

        for batch in batches:
            held, size = [], 0
            for _, words, cuts in _pieces(batch["text"]):
                place, term = _found(words, terms)
                text = np.searchsorted(cuts, place, "right") - 1
                passages = -(-np.diff(cuts) // passage)
                # A term counts once in a passage; those of a text follow those of the texts before.
                pair = np.unique((count + (np.cumsum(passages) - passages)[text] + (place - cuts[text]) // passage) * len(terms) + term)
                ends = np.searchsorted(pair, (count + np.cumsum(passages)) * len(terms))
                count += int(passages.sum())
                # Sums are rounded, so they begin anew after the same text however texts lie in pieces.
                done = 0
                while (full := int(np.searchsorted(ends, done + 20_000 - size, "right"))) < len(ends):
                    pairs = np.concatenate([*held, pair[done:ends[full]]])
                    held, size, done = [], 0, int(ends[full])
                    df += np.bincount(pairs % len(terms), minlength=len(terms))
                    add(pairs // len(terms), pairs % len(terms))
                held.append(pair[done:])
                size += len(pair) - done
            if size:
                pairs = np.concatenate(held)
                df += np.bincount(pairs % len(terms), minlength=len(terms))
                add(pairs // len(terms), pairs % len(terms))
        if count:
            cuts = range(0, len(terms), 64)
            yield pd.DataFrame({"part": list(cuts), "count": [count if c == 0 else 0 for c in cuts], "df": [df[c:c + 64].tobytes() for c in cuts],
                                "total": [total[c:c + 64].tobytes() for c in cuts]})
    return run


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    add = lambda column, kind: sum(np.frombuffer(x, kind) for x in group[column]).tobytes()
    return pd.DataFrame({"part": group["part"].iloc[:1], "count": [group["count"].sum()], "df": [add("df", np.int64)], "total": [add("total", np.float64)]})


def fit(docs: DataFrame, items: Items, rank: int = RANK, extra: int = EXTRA, passage: int = PASSAGE) -> Items:
    """The latent space of a block: a randomised singular value decomposition of the TF-IDF passages of all documents.

    Passages are `passage` words in a row, each document cut from its start; a column is a term of the block. One
    pass over the corpus multiplies A'A with a random matrix, task by task, and the sums give the range. The items
    are passages too, with as much weight as all others together, or a space of common themes would hold no item.
    """
    spark = docs.sparkSession
    size = min(rank + extra, len(items.terms))
    omega = np.random.default_rng(SEED).standard_normal((len(items.terms), size)).astype(np.float32)
    shared, random = spark.sparkContext.broadcast(items), spark.sparkContext.broadcast(omega)
    schema = "part long, count long, df binary, total binary"
    parts = docs.select("text").mapInPandas(_sketch(shared, random, passage), schema).groupBy("part").applyInPandas(_add_up, schema).collect()
    parts.sort(key=lambda r: r["part"])
    count = sum(r["count"] for r in parts)
    df = np.concatenate([np.frombuffer(r["df"], np.int64) for r in parts]) if parts else np.zeros(len(items.terms), np.int64)
    total = np.concatenate([np.frombuffer(r["total"], np.float64) for r in parts]).reshape(-1, size) if parts else np.zeros(omega.shape)
    idf = np.log((count + 1) / (df + 1)) + 0.1
    own = items.rows().astype(np.float64)
    range_ = total / max(count, 1) + own.T @ (own @ omega) / len(own)
    # A'A ~ Y (O'Y)^-1 Y', scaled by idf on both sides; its factor's left singular vectors are the latent space.
    core = omega.astype(np.float64).T @ range_
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-9
    factor = idf[:, None] * (range_ @ (vector[:, good] / np.sqrt(value[good])))
    left, _, _ = np.linalg.svd(factor, full_matrices=False)
    items.vectors = (idf[:, None] * left[:, :rank]).astype(np.float32)
    latent = own.astype(np.float32) @ items.vectors
    # Which items hold a term: all holders term by term, where each term's begin, and how many they are.
    size = (own > 0).sum(axis=0)
    items.holders = (np.nonzero(own.T)[1], np.cumsum(size) - size, size)
    items.need = np.clip([_certain(w, items.terms, passage) // 2 for w in items.words], 1, MIN_TERMS)
    items.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    items.known = [np.unique(w) for w in items.words]
    # Without a given answer, the rarest third of an item's terms stands for it.
    items.keys = [a if len(a) else items.terms[np.flatnonzero(r)[np.argsort(-idf[np.flatnonzero(r)], kind="stable")][:max(1, int(r.sum()) // 3)]]
                  for a, r in zip(items.answers, own)]
    return items


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of a."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = v & masks.get(w, 0)
        if m:
            v = (v + m | v - m) & full
    return len(a) - v.bit_count()


def _best(words: np.ndarray, windows: np.ndarray, items: Items, item: int, passage: int, paraphrase: float, verbatim: float) -> tuple[float, int, int]:
    """(share, first, last) of the place among a text's windows that holds most of an item; share 0 if none holds enough."""
    wanted, known, best = items.words[item], items.known[item], (0.0, 0, 0)
    begin = windows * (passage // 2)
    low, high = np.maximum(begin - len(wanted), 0), np.minimum(begin + passage + len(wanted), len(words))
    # Words of the item are told once for all windows; only they can be in a common subsequence.
    base = low[0]
    span = words[base:high[-1]]
    place = np.flatnonzero(known[np.minimum(np.searchsorted(known, span), len(known) - 1)] == span) + base
    held = span[place - base]
    first, last = np.searchsorted(place, low), np.searchsorted(place, high)
    for w in np.flatnonzero(last - first >= paraphrase * len(wanted)):
        if last[w] - first[w] <= best[0] * len(wanted):
            continue
        share = common_subsequence(wanted, held[first[w]:last[w]]) / len(wanted)
        if share > best[0] and (share >= verbatim or share >= paraphrase and 2 * np.isin(items.keys[item], words[low[w]:high[w]]).sum() >= len(items.keys[item])):
            best = (share, int(low[w]), int(high[w]))
    return best


def _search(shared, passage: int, cosine: float, paraphrase: float, verbatim: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        step = passage // 2
        for batch in batches:
            out, held, texts, size, n_words = [], [], [], 0, 0

            def near() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                """(text, window, item) of the windows near an item."""
                owner, where, term = (np.concatenate(x) for x in zip(*held))
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (where[1:] != where[:-1])]))
                sizes = np.diff(np.concatenate([first, [len(term)]]))
                enough = np.repeat(sizes >= items.need.min(), sizes)
                owner, where, term = owner[enough], where[enough], term[enough]
                sizes = sizes[sizes >= items.need.min()]
                first = np.cumsum(sizes) - sizes
                # Only windows that share enough terms with one item are worth projecting.
                holder, start, count = items.holders
                window = np.repeat(np.arange(len(first)), sizes)
                times = count[term]
                item = holder[np.repeat(start[term] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
                pair, shared = np.unique(np.repeat(window, times) * len(items.ids) + item, return_counts=True)
                pair = pair[shared >= items.need[pair % len(items.ids)]]
                some = np.unique(pair // len(items.ids))
                if not len(some):
                    return
                # Items that are sure of few terms cannot be told by their cosine: the subsequence alone decides.
                few = pair[items.need[pair % len(items.ids)] < MIN_TERMS]
                at = first[few // len(items.ids)]
                yield owner[at], where[at], few % len(items.ids)
                keep = np.zeros(len(first), bool)
                keep[some] = True
                rows = _sums(items.vectors[term[keep[window]]], window[keep[window]])
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                for s in range(0, len(rows), 8192):
                    r, i = np.nonzero(rows[s:s + 8192] @ items.latent.T >= cosine)
                    at = first[some[s + r]]
                    yield owner[at], where[at], i

            def flush() -> None:
                nonlocal size, n_words
                found = list(near()) if size else []
                if found:
                    text, window, item = (np.concatenate(x) for x in zip(*found))
                    order = np.lexsort((window, item, text))
                    text, window, item = text[order], window[order], item[order]
                    again = (text[1:] == text[:-1]) & (item[1:] == item[:-1])
                    new = np.concatenate([[True], ~again | (window[1:] != window[:-1])])[:len(text)]
                    text, window, item = text[new], window[new], item[new]
                    cuts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])[:len(text)]).tolist()
                    for a, b in zip(cuts, [*cuts[1:], len(text)]):
                        d, i = int(text[a]), int(item[a])
                        best = _best(texts[d - begun], window[a:b], items, i, passage, paraphrase, verbatim)
                        if best[0]:
                            out.append((batch[KEY].iloc[d], batch["doc_id"].iloc[d], items.ids[i], *best))
                held.clear()
                texts.clear()
                size = n_words = 0

            begun = 0
            for at, words, cuts in _pieces(batch["text"]):
                begun = begun if texts else at
                texts += [words[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                n_words += len(words)
                place, term = _found(words, items.terms)
                text = np.searchsorted(cuts, place, "right") - 1
                # Windows overlap by half, so a place lies in two; a term counts once in each.
                window = (place - cuts[text]) // step
                most = int(window.max(initial=0)) + 1
                window += text * most
                more = window % most > 0
                pair = np.unique(np.concatenate([window, window[more] - 1]) * len(items.terms) + np.concatenate([term, term[more]]))
                window, term = pair // len(items.terms), pair % len(items.terms)
                held.append((at + window // most, window % most, term))
                size += len(pair)
                if size > 40_000 or n_words > 4_000_000:
                    flush()
            flush()
            yield pd.DataFrame(out, columns=[KEY, "doc_id", "item_id", "share", "first_word", "last_word"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, rank: int = RANK, cosine: float = COSINE, paraphrase: float = PARAPHRASE,
               verbatim: float = VERBATIM, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and benchmark item found in it: row key, doc_id, item_id, share, first_word, last_word.

    Documents are cut into overlapping windows of 32 words; windows that share enough terms with some item (half of
    what a copy of it is sure to have in one window, one at least and three at most) are projected into the latent space of `fit` and compared with every item by cosine. Where it reaches `cosine`, and for every
    item of which fewer than three terms are asked, share is the longest common subsequence of the item's words and those around the window, over the item's
    length. The item is found if share is at least `verbatim`, or at least `paraphrase` and half the answer's
    words stand there too (the item's rarest terms if the benchmark has no column `answer`).

    Words are letters and digits in lower case. Null and empty items are never found, nor is anything in a null
    text. Equal rows are found alike; equal items each. Either table may be empty. The benchmark is searched for in
    blocks of at most 2048 items or 200 000 words, each one pass over the documents and one to fit.
    """
    spark, out = docs.sparkSession, None
    kinds = {f.name: f.dataType.simpleString() for f in [docs.schema["doc_id"], benchmark.schema["item_id"]]}
    # Ids travel as text: a null among whole numbers would turn them into fractions.
    schema = f"{KEY} binary, doc_id string, item_id string, share double, first_word long, last_word long"
    rows = docs.select(row_key("doc_id", "text").alias(KEY), F.col("doc_id").cast("string").alias("doc_id"), "text")
    for items in blocks(benchmark, block_items, block_words):
        shared = spark.sparkContext.broadcast(fit(docs, items, rank, passage=passage))
        found = rows.mapInPandas(_search(shared, passage, cosine, paraphrase, verbatim), schema)
        out = found if out is None else out.union(found)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item."""
    found = find_leaks(docs, benchmark, **options).select(KEY).distinct()
    return docs.select(whole_row(docs), row_key("doc_id", "text").alias(KEY)).join(found, KEY, "left_anti").select("row.*")
