"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words (maximal runs of characters that are
not ASCII white space); lines of fewer than ``min_words`` words only go as exact repeats, and not
even then without ``short_repeats`` (blank lines always stay).
Of equal lines the earliest by (document id, line number) stays.  Two different
lines are near when their word edit distance is at most one; a line goes when
some earlier line is near it.

Every line emits itself and all its variants with one word deleted, as 128-bit
keys.  Equal keys that come from the same deleted position are one substitution
apart, and a line that equals another's variant is one deletion apart, and every pair
within the bound meets in one of these two ways.  So each group only needs its earliest
member, never its pairs; the edit distance of the found pair is verified on the words.

Two lossless filters keep the work small: only the earliest of equal lines
takes part, and only if it shares a half with another line (two lines within one
edit have equal first or last halves).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import materialise, sized, slices, temporary, tidy
from docket.llm.hashing import M1, M2, RangeHash, mix, signed, word_cache

MIN_WORDS = 5
ROW = ["doc_id", "th", "line"]  # a line's place: document id, hash of the document's text, line number
LINE_SCHEMA = "h1 bigint, h2 bigint, doc_id bigint, th bigint, line int, halves array<bigint>"


def _batch_words(texts: list[bytes], cache) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all lines, and the lines' bounds."""
    words = [t.split() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.fromiter((cache[w] for ws in words for w in ws), dtype=np.uint64, count=int(ends[-1])), ends


def half_keys(h: RangeHash, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four keys per line: first and last half, cut as in a pair whose shorter line has n or n - 1 words."""
    out = []
    for m in (b - a, b - a - 1):
        half = m // 2
        tag = m.astype(np.uint64) * np.uint64(M1)
        out += [mix(h(a, a + half) + tag), mix(h(b - (m - half), b) ^ tag ^ np.uint64(M2))]
    return np.stack(out, axis=1)


def _lines(min_words: int, short_repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache()
        for batch in batches:
            for piece in slices(batch):
                docs = [t.encode("utf-8", "replace").split(b"\n") for t in piece.column("text").to_pylist()]
                words, ends = _batch_words([line for d in docs for line in d], cache)
                size = [len(d) for d in docs]
                keep = np.flatnonzero(np.diff(ends) >= (1 if short_repeats else min_words))
                a, b = ends[keep], ends[keep + 1]
                h1, h2 = RangeHash(words, M1), RangeHash(words, M2)
                doc = np.repeat(np.arange(len(docs)), size)[keep]
                line = (np.arange(sum(size)) - np.repeat(np.cumsum(size) - size, size))[keep]
                full = b - a >= min_words  # shorter lines have no halves, so that they are near nothing
                halves = signed(half_keys(h1, a[full], b[full])).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h1(a, b))), pa.array(signed(h2(a, b))), piece.column("doc_id").take(pa.array(doc)),
                     piece.column("th").take(pa.array(doc)), pa.array(line.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * full)]).astype(np.int32)), pa.array(halves))],
                    ["h1", "h2", "doc_id", "th", "line", "halves"])

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document."""
    for b in batches:
        for piece in slices(b):
            out = [(i, n, t.split("\n")[n]) for i, (t, wanted) in enumerate(zip(piece.column("text").to_pylist(), piece.column("wanted").to_pylist(), strict=True))
                   for n in wanted]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(at), piece.column("th").take(at), pa.array([o[1] for o in out], pa.int32()),
                                              pa.array([o[2] for o in out], pa.string())], [*ROW, "body"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's own key (position -1) and the keys of all its variants with one word deleted."""
    cache = word_cache()
    for b in batches:
        for piece in slices(b, "body", 200_000):
            words, ends = _batch_words([t.encode("utf-8", "replace") for t in piece.column("body").to_pylist()], cache)
            n = np.diff(ends)
            a, z = ends[:-1], ends[1:]
            who = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), n)])
            pos = np.concatenate([np.full(len(n), -1), np.arange(len(words)) - np.repeat(a, n)])
            keys = [np.concatenate([h(a, z), h.without(np.repeat(a, n), np.arange(len(words)), np.repeat(z, n))])
                    for h in (RangeHash(words, M1), RangeHash(words, M2))]
            who = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[0])), pa.array(signed(keys[1])), pa.array(pos.astype(np.int32)),
                                              *[piece.column(c).take(who) for c in ROW]], ["v1", "v2", "pos", *ROW])


def within_one_edit(a: list, b: list) -> bool:
    """Whether one insertion, deletion or substitution at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = zip(b.column("body").to_pylist(), b.column("other").to_pylist(), strict=True)
        yield b.select(ROW).filter(pa.array([within_one_edit(x.encode("utf-8", "replace").split(), y.encode("utf-8", "replace").split()) for x, y in pairs], pa.bool_()))


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near: bool = True,
               short_repeats: bool = True) -> DataFrame:
    """Lines to drop: ``doc_id, th, line, why`` with why ``exact`` or ``near`` (th: xxhash64 of the document's text, line counts from 0)."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    keyed = _keyed(docs, id_col, text_col).filter("text IS NOT NULL")
    lines = materialise(keyed.mapInArrow(tidy(_lines(min_words, short_repeats)), LINE_SCHEMA), "lines").select("h1", "h2", F.struct(*ROW).alias("me"), "halves")
    # repeated lines: counted first, so that only they are looked at by place
    many = _stored(lines.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "repeated")
    firsts = _stored(lines.join(many, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("me").alias("first")), "firsts")
    gone = (lines.join(firsts, ["h1", "h2"]).filter(~F.col("me").eqNullSafe(F.col("first"))).select("me", F.lit("exact").alias("why")))
    if near:
        doomed = _stored(near_lines(keyed, lines, firsts), "near-lines")
        # all occurrences of a line with an earlier near one go; repeats are in already
        gone = gone.unionByName(doomed.select("me", F.lit("near").alias("why")))
    return gone.select("me.*", "why").distinct()


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written, with a broadcast hint if it turned out small."""
    out = materialise(df, tag)
    return sized(out, out.count())


def near_lines(keyed: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Places ``me`` of first occurrences that have an earlier line within one edit."""
    halves = lines.select(F.explode("halves").alias("half"), "h1")
    shared = _stored(halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low != high").select("half"), "shared-halves")
    rows = lines.join(firsts, ["h1", "h2"], "left").filter(F.col("first").isNull() | F.col("me").eqNullSafe(F.col("first")))
    rows = rows.select("me", F.explode("halves").alias("half")).join(shared, "half", "left_semi")
    wanted = materialise(rows.select("me.*").groupBy("doc_id", "th").agg(F.collect_set("line").alias("wanted")), "wanted")
    size = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    texts = (keyed.join(sized(wanted, size), _same(keyed, wanted, ["doc_id", "th"])).select(keyed["doc_id"], keyed["th"], "text", "wanted"))
    bodies = materialise(texts.mapInArrow(tidy(_pick), "doc_id bigint, th bigint, line int, body string"), "half-sharing-lines").dropDuplicates(ROW)

    variants = materialise(bodies.mapInArrow(tidy(_variants), "v1 bigint, v2 bigint, pos int, doc_id bigint, th bigint, line int"), "variants")
    variants = variants.select("v1", "v2", "pos", F.struct(*ROW).alias("me"))
    # keys of one line alone cannot match anything
    several = _stored(variants.groupBy("v1", "v2").count().filter("count > 1").select("v1", "v2"), "shared-variants")
    variants = variants.join(several, ["v1", "v2"])
    same_place = materialise(variants.groupBy("v1", "v2", "pos").agg(F.min("me").alias("twin")), "twins")
    groups = same_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("pos") == -1, F.col("twin"))).alias("whole"),
                                                F.min(F.when(F.col("pos") >= 0, F.col("twin"))).alias("shortened"))
    small = variants.join(groups, ["v1", "v2"]).join(same_place, ["v1", "v2", "pos"])
    # a variant may match its twin (same position) or a whole line; a whole line may match another's variant
    options = F.when(F.col("pos") == -1, F.array("shortened")).otherwise(F.array("twin", "whole"))
    pairs = (small.select("me", F.explode(options).alias("other")).filter("other IS NOT NULL AND other < me").distinct())
    own = bodies.select(F.struct(*ROW).alias("me"), "body")
    full = (pairs.join(own, "me").join(own.select(F.col("me").alias("other"), F.col("body").alias("other_body")), "other")
            .select("me.*", "body", F.col("other_body").alias("other")))
    return full.mapInArrow(_verify, "doc_id bigint, th bigint, line int").select(F.struct(*ROW).alias("me")).distinct()


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in slices(b):
            texts = []
            for t, gone in zip(piece.column("text").to_pylist(), piece.column("gone").to_pylist(), strict=True):
                drop = set(gone or ())
                texts.append(t if not drop else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "clean_text" else piece.column(n)
                                              for n in ("row", "clean_text", "n_exact", "n_near")], ["row", "clean_text", "n_exact", "n_near"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near: bool = True,
                short_repeats: bool = True) -> DataFrame:
    """``row`` (struct of all columns of ``docs``), ``clean_text``, ``n_exact``, ``n_near`` (dropped lines of each kind).

    A NULL text stays NULL and takes no part.  Rows that repeat a document (same id and
    text) are one document: they lose the same lines.  Ids may be NULL (they sort first).
    A text that loses all its lines becomes empty.  An empty table gives an
    empty result; columns keep their names inside ``row``, so none can clash.
    Texts of any length are read whole.
    """
    with temporary(docs.sparkSession) as keep:
        drops = keep(materialise(line_drops(docs, id_col, text_col, min_words, near, short_repeats), "dropped-lines"))
    gone = (drops.groupBy("doc_id", "th")
            .agg(F.collect_list("line").alias("gone"), F.sum(F.when(F.col("why") == "exact", 1).otherwise(0)).alias("n_exact"),
                 F.sum(F.when(F.col("why") == "near", 1).otherwise(0)).alias("n_near")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"doc_id": F.col("row")[id_col].cast("bigint"), "th": F.xxhash64(F.col("row")[text_col])})
    joined = rows.join(gone, _same(rows, gone, ["doc_id", "th"]), "left").select(
        "row", F.col("row")[text_col].cast("string").alias("text"), "gone", F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"))
    kind = rows.schema["row"].dataType.simpleString()
    return joined.mapInArrow(tidy(_clean), f"row {kind}, clean_text string, n_exact bigint, n_near bigint")
