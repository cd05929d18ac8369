"""Evaluation passages that stand in training texts (problem 9).

A passage is a window of 12 consecutive words of an item (32 consecutive letters or digits where
the language writes without spaces). All shingles of a window must stand in a document that holds
it, so one of them, the rarest in the corpus, is the prefix that has to be joined: a prefix-filtered
set join with containment 1. Documents that share a prefix shingle at a position where the whole
window fits are verified unit by unit over item-sized windows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscape.llm.tokens import single_texts
from fellscape.session import cut

#: Units of a window and of a shingle, by kind of unit.
WINDOW = {"word": 12, "char": 32}
SHINGLE = {"word": 5, "char": 12}
UNSPACED = ("zh", "ja")
#: Distinct item shingles that are sent to the tasks at most (16 bytes each); beyond that a join.
SENT_SHINGLES = 4_000_000

_UNITS = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]+")


def normalized(text: str) -> str:
    """Compatibility form, folded case, without invisible characters; accents stay."""
    folded = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", folded))


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of a text, normalized."""
    return _UNITS.findall(normalized(text))


def units_of(words: list[str], kind: str) -> np.ndarray:
    """64-bit hashes of the words, or of the single letters and digits."""
    if kind == "word":
        if not words:
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def rolled(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` units."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0xD1B54A32D192ED03) + units[k : k + n]
            out ^= out >> np.uint64(29)
    return out


def kinds_of(lang: str | None) -> tuple[str, ...]:
    return ("word", "char") if (lang or "").strip().lower()[:2] in UNSPACED else ("word",)


def item_shingles(items: DataFrame) -> DataFrame:
    """(kind, item_id, at, size, shingle) of every item; items with fewer units than a window have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text or "")
                for kind in kinds_of(lang):
                    units = units_of(words, kind)
                    if len(units) >= WINDOW[kind]:
                        h = rolled(units, SHINGLE[kind]).view(np.int64)
                        n = len(h)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * n), pa.array([item] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.full(n, len(units))), pa.array(h)],
                            names=["kind", "item_id", "at", "size", "shingle"],
                        )

    rows = items.where("item_id is not null and text is not null").select("item_id", "text", "lang").distinct()
    return rows.mapInArrow(run, "kind STRING, item_id BIGINT, at BIGINT, size BIGINT, shingle BIGINT")


def corpus_shingles(texts: DataFrame, wanted: dict[str, np.ndarray] | None, kinds: list[str]) -> DataFrame:
    """(doc_id, kind, at, size, shingle) of the documents' shingles that are ``wanted`` (all if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [words_of(t or "") for t in b.column(1).to_pylist()]
            for kind in kinds:
                units = [units_of(w, kind) for w in words] if kind == "char" else _split_units(words)
                for doc, u in zip(ids, units):
                    h = rolled(u, SHINGLE[kind]).view(np.int64)
                    at = np.arange(len(h))
                    if wanted is not None and len(h):
                        known = wanted[kind]
                        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                    if len(at):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc] * n, pa.int64()), pa.array([kind] * n), pa.array(at), pa.array(np.full(n, len(u))), pa.array(h[at])],
                            names=["doc_id", "kind", "at", "size", "shingle"],
                        )

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, kind STRING, at BIGINT, size BIGINT, shingle BIGINT")


def _split_units(words: list[list[str]]) -> list[np.ndarray]:
    """Word hashes of several texts, hashed together."""
    flat = units_of([w for ws in words for w in ws], "word")
    return np.split(flat, np.cumsum([len(w) for w in words])[:-1]) if words else []


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds a window of the item.

    Null and blank texts hold nothing; repeated rows count once; documents of any length are read
    whole. Rarity is the number of documents with the shingle, over the whole corpus.
    """
    texts = single_texts(documents)
    parts = cut(item_shingles(items))
    kinds = sorted(r[0] for r in parts.select("kind").distinct().collect())
    distinct = parts.select("kind", "shingle").distinct()
    if not kinds:
        return parts.select(F.col("item_id").alias("doc_id"), "item_id")
    if distinct.count() <= SENT_SHINGLES:
        sent = distinct.toPandas()
        wanted = {k: np.sort(g["shingle"].to_numpy(np.int64)) for k, g in sent.groupby("kind")}
        hits = corpus_shingles(texts, wanted, kinds)
    else:
        hits = corpus_shingles(texts, None, kinds).join(distinct, ["kind", "shingle"], "left_semi")
    hits = cut(hits)
    rarity = hits.groupBy("kind", "shingle").agg(F.count_distinct("doc_id").alias("df"))
    prefixes = _prefixes(parts.join(rarity, ["kind", "shingle"], "left").withColumn("df", F.coalesce("df", F.lit(0))))
    # positional bound: the window that starts at item position w must lie inside the document
    met = hits.join(prefixes.where("df > 0"), ["kind", "shingle"])
    start = F.col("at") - (F.col("item_at") - F.col("window_at"))
    length = F.when(F.col("kind") == "word", WINDOW["word"]).otherwise(WINDOW["char"])
    candidates = met.where((start >= 0) & (start + length <= F.col("size"))).select("doc_id", "kind", "item_id", "window_at", start.alias("start")).distinct()
    return _verified(candidates, texts, items)


def _prefixes(parts: DataFrame) -> DataFrame:
    """Rarest shingle of every window: (kind, shingle, item_id, window_at, item_at, df)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("at").sort_values("at")
        kind = frame["kind"].iloc[0]
        span = WINDOW[kind] - SHINGLE[kind] + 1
        df, sh = frame["df"].to_numpy(), frame["shingle"].to_numpy()
        rows = []
        for w in range(len(frame) - span + 1):
            at = w + min(range(span), key=lambda i: (df[w + i], sh[w + i]))
            rows.append((kind, sh[at], frame["item_id"].iloc[0], w, at, df[at]))
        return pd.DataFrame(rows, columns=["kind", "shingle", "item_id", "window_at", "item_at", "df"])

    return parts.groupBy("kind", "item_id").applyInPandas(run, "kind STRING, shingle BIGINT, item_id BIGINT, window_at BIGINT, item_at BIGINT, df BIGINT")


def item_windows(items: DataFrame) -> DataFrame:
    """(kind, item_id, window_at, passage): every window of every item as text, units parted by a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text or "")
                for kind in kinds_of(lang):
                    units = words if kind == "word" else list("".join(words))
                    n = WINDOW[kind]
                    rows += [(kind, item, w, " ".join(units[w : w + n])) for w in range(len(units) - n + 1)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["kind", "item_id", "window_at", "passage"])

    rows = items.where("item_id is not null and text is not null").select("item_id", "text", "lang").distinct()
    return rows.mapInArrow(run, "kind STRING, item_id BIGINT, window_at BIGINT, passage STRING")


def _verified(candidates: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates whose window stands in the document unit by unit."""
    windows = candidates.join(item_windows(items), ["kind", "item_id", "window_at"]).select("doc_id", "kind", "item_id", "start", "passage")
    per_doc = windows.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "kind", "start", "passage")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = [], []
            for doc, tries, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text or "")
                units = {"word": words, "char": "".join(words)}
                held = {c["item_id"] for c in tries if " ".join(units[c["kind"]][c["start"] : c["start"] + WINDOW[c["kind"]]]) == c["passage"]}
                docs += [doc] * len(held)
                found += sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return per_doc.join(texts, "doc_id").select("doc_id", "c", "text").mapInArrow(run, "doc_id BIGINT, item_id BIGINT").distinct()
