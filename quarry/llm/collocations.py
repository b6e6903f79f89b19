"""Phrase collocations by Rabin-Karp fingerprints.

1. A task hashes every n-gram of its texts from prefix polynomials modulo 2^64 (bytes to words, words to
   n-grams), counts equal fingerprints and keeps one occurrence pointer (document, byte offset) of each.  One pass per
   length: an n-gram is sent only if both its (n-1)-grams may occur ``min_count`` times, by a bitmap of
   ``2^BITMAP_BITS`` bits that misses none of them (a wrong bit only costs rows).
2. Fingerprints are shuffled in packed ranges and summed; those seen ``min_count`` times stay, with two
   pointers into different chunks where there are any.
3. The documents pointed at are read again: each pointer's words are hashed and must give the fingerprint
   back, and both pointers must hold the same words.  Otherwise two phrases collided, and the whole count is
   repeated with other polynomials.  Within a chunk and between chunks eight bits of a second, independent
   polynomial keep colliding phrases apart as well.
4. Only these frequent phrases exist as text; scores, containment and ranks are exact arithmetic on them.

Texts are lower-cased (A-Z), cut at ``[.,;:!?`` and line ends ``]`` into pieces and these at blanks and tabs
into words; n-grams do not cross pieces.  All counts are per language (null: ``und``).

Defined results: null and empty texts have no word; repeated rows count each; texts of any length are read
whole (in blocks that end between pieces); an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.batches import arrow_batches
from quarry.llm.blobs import deltas, narrow, pack, range_of, undelta, unpack
from quarry.llm.polyhash import Polynomial
from quarry.llm.shingles import mix
from quarry.operators.relational import skew_join
from quarry.session import cut_lineage, drop_lineage

MIN_COUNT, MAX_WORDS, TOP, SEED = 10, 3, 2000, 1
BLOCK, CHUNK_WORDS, BITMAP_BITS = 1 << 20, 1_500_000, 26
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[list(SEPARATORS)] = True
_GAP[list(SEPARATORS + b" \t")] = True
_WORD = rb"[^ \t.,;:!?\n-\r]+"


def lang_code(lang: str, seed: int) -> np.uint64:
    """A 64-bit number of a language, mixed into the fingerprints of its n-grams."""
    p = Polynomial(seed + 77)
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return p.words(data, np.array([0]), np.array([data.size]))[0]


def blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (text number, offset, bytes) of about ``BLOCK`` bytes; long texts are cut after a separator."""
    run, size = [], 0
    for i, data in enumerate(texts):
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > BLOCK:
                cut = max(data.rfind(bytes([c]), at, at + BLOCK) for c in SEPARATORS) + 1
                if cut <= at:
                    later = [x for x in (data.find(bytes([c]), at + BLOCK) for c in SEPARATORS) if x >= 0]
                    cut = min(later) + 1 if later else end
                end = cut
            run.append((i, at, data[at:end]))
            size += end - at
            at = end
            if size >= BLOCK:
                yield run
                run, size = [], 0
    if run:
        yield run


class Grams:
    """Words of a chunk of texts and the fingerprints of their n-grams."""

    def __init__(self, seed: int):
        self.polys = (Polynomial(seed), Polynomial(seed + 500))
        self.parts: list[tuple] = []
        self.n = self.pieces = 0

    def add(self, run: list[tuple[int, int, bytes]], first_doc: int) -> None:
        data = np.frombuffer(b"\n".join(part for _, _, part in run), np.uint8)
        inside = ~_GAP[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        if not start.size:
            return
        cuts = np.cumsum(_CUT[data], dtype=np.int64)
        lengths = np.array([len(part) + 1 for _, _, part in run])
        begin = np.cumsum(lengths) - lengths
        part = np.searchsorted(begin, start, "right") - 1
        docs, at = np.array([i for i, _, _ in run]), np.array([a for _, a, _ in run])
        self.parts.append((*[p.words(data, start, end) for p in self.polys], cuts[start] + self.pieces,
                           (docs[part] + first_doc).astype(np.int32), start - begin[part] + at[part]))
        self.n += start.size
        self.pieces += int(cuts[-1]) + 1

    def take(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n, self.pieces = [], 0, 0
        return out

    def ngrams(self, words: tuple[np.ndarray, ...], langs: np.ndarray, n: int,
               common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and check bytes of all n-grams inside a piece, and their first words; with ``common``, which
        marks the (n-1)-grams that begin at a word, only those whose both (n-1)-grams are marked."""
        one, two, piece, doc, _ = words
        first = np.flatnonzero(piece[:piece.size - n + 1] == piece[n - 1:]) if piece.size >= n else np.zeros(0, np.int64)
        if common is not None:
            first = first[common[first] & common[first + 1]]
        salt = langs[doc[first]] + np.uint64(n)
        fp, chk = [mix(p.spans(h, first, first + n) + salt) for p, h in zip(self.polys, (one, two))]
        return fp, (chk & np.uint64(255)).astype(np.uint8), first


def _marked(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp & np.uint64((1 << BITMAP_BITS) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counter(seed: int, groups: int, orders: range, chunk_words: int, marks=None):
    """Texts -> packed counts of n-grams of these orders per range of fingerprints; order 0 counts the words of each
    language.  ``marks``: a broadcast bitmap of the (n-1)-grams that occur often enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[str, np.uint64] = {}
        grams, keys, langs = Grams(seed), [], []

        def flush() -> Iterator[pd.DataFrame]:
            if not grams.n:
                return
            words, lang, key = grams.take(), np.array(langs, np.uint64), np.array(keys, np.int64)
            out: dict[int, list] = {}
            common = None
            if marks is not None:
                common = np.zeros(words[3].size, bool)
                fp, _, first = grams.ngrams(words, lang, orders[0] - 1)
                common[first] = _marked(marks.value, fp)
                del fp, first
            for n in orders:
                if n:
                    fp, chk, first = grams.ngrams(words, lang, n, common)
                else:
                    fp, chk, first = mix(lang[words[3]]), np.zeros(words[3].size, np.uint8), np.arange(words[3].size)
                order = np.argsort(fp)
                fp, chk, first = fp[order], chk[order], first[order]
                del order
                if not fp.size:
                    continue
                new = np.ones(fp.size, bool)
                new[1:] = (fp[1:] != fp[:-1]) | (chk[1:] != chk[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, fp.size))
                fp, chk, first = fp[at], chk[at], first[at]
                doc, pos = words[3][first], words[4][first]
                group = range_of(fp, groups)
                edge = np.append(np.flatnonzero(np.diff(group, prepend=np.uint64(groups + 1))), group.size)
                for a, z in zip(edge[:-1], edge[1:]):
                    out.setdefault(int(group[a]), []).append((n, doc[a:z], [deltas(fp[a:z]), narrow(count[a:z]), chk[a:z], narrow(pos[a:z])]))
            rows = []
            for g, sections in out.items():
                used, local = np.unique(np.concatenate([d for _, d, _ in sections]), return_inverse=True)
                rows.append((g, pack(np.array([n for n, _, _ in sections], np.int16), key[used], narrow(local),
                                     *[x for _, _, s in sections for x in s])))
            yield pd.DataFrame(rows, columns=["g", "blob"])

        for pdf in batches:
            texts = [t.encode("utf-8", "surrogatepass").lower() for t in pdf["text"]]
            for lang in set(pdf["lang"]) - set(codes):
                codes[lang] = lang_code(lang, seed)
            first_doc = len(keys)
            keys.extend(pdf["h"])
            langs.extend(codes[x] for x in pdf["lang"])
            for part in blocks(texts):
                grams.add(part, first_doc)
                if grams.n >= chunk_words:
                    yield from flush()
            if not grams.n:
                keys, langs = [], []
        yield from flush()

    return run


def _summed(min_count: int):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sections: dict[int, list] = {}
        for blob in pdf["blob"]:
            kinds, key, local, *arrays = unpack(blob)
            begin = 0
            for j, n in enumerate(kinds):
                step, count, chk, pos = arrays[4 * j:4 * j + 4]
                doc = key[local[begin:begin + step.size]]
                begin += step.size
                sections.setdefault(int(n), []).append((undelta(step), chk, count.astype(np.int64), doc, pos.astype(np.int64)))
        frames = []
        for n, parts in sections.items():
            fp, chk, count, doc, pos = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            order = np.argsort(fp)
            same = fp[order][1:] == fp[order][:-1]
            if (chk[order][1:][same] != chk[order][:-1][same]).any():
                order = np.lexsort((chk, fp))
            fp, chk = fp[order], chk[order]
            new = np.ones(fp.size, bool)
            new[1:] = (fp[1:] != fp[:-1]) | (chk[1:] != chk[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(count[order], at)
            keep = total >= (min_count if n else 1)
            first, last = order[at], order[np.append(at[1:], fp.size) - 1]
            frames.append(pd.DataFrame({
                "n": np.full(int(keep.sum()), n, np.int32), "fp": fp[at][keep].view(np.int64), "chk": chk[at][keep].astype(np.int32),
                "f": total[keep], "d1": doc[first][keep], "p1": pos[first][keep], "d2": doc[last][keep], "p2": pos[last][keep]}))
        return pd.concat(frames) if frames else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("n", "fp", "chk", "f", "d1", "p1", "d2", "p2")})

    return add


def _bitmap(grams: DataFrame) -> np.ndarray:
    """One bit per hash range for the fingerprints in ``fp``: a filter of fixed size that never misses one."""
    at = F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = grams.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr(
        f"shiftleft(1L, CAST((fp & {(1 << BITMAP_BITS) - 1}L) & 63L AS INT))")).alias("w")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[rows["i"].to_numpy()] = rows["w"].to_numpy()
    return out.view(np.uint64)


def _reader(seed: int):
    """Pointers -> phrases, each hashed again from its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = {n: re.compile(rb"[ \t]+".join([_WORD] * n)) for n in range(1, 64)}
        for pdf in batches:
            rows, phrases = [], []
            for lang, text, at in zip(pdf["lang"], pdf["text"], pdf["at"]):
                data = text.encode("utf-8", "surrogatepass").lower()
                for p in at:
                    found = spans[p["n"]].match(data, p["pos"]) if p["n"] else None
                    phrases.append(b" ".join(found.group().split()) if found else b"")
                    rows.append((lang, p["n"], p["fp"], p["chk"], p["f"]))
            out = pd.DataFrame(rows, columns=["lang", "n", "fp", "chk", "f"])
            out["phrase"] = [p.decode("utf-8", "surrogatepass") for p in phrases]
            out["ok"] = rehash(phrases, out, seed)
            yield out

    return run


def rehash(phrases: list[bytes], rows: pd.DataFrame, seed: int) -> np.ndarray:
    """Whether each phrase gives its fingerprint and check byte."""
    grams = Grams(seed)
    ok = rows["n"].to_numpy() == 0
    for run in blocks([p + b"\n" for p in phrases]):
        grams.add(run, 0)
    if not grams.n:
        return ok
    words = grams.take()
    codes = {lang: lang_code(lang, seed) for lang in set(rows["lang"])}
    langs = np.array([codes[x] for x in rows["lang"]], np.uint64)
    want, check, n_of = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["chk"].to_numpy(), rows["n"].to_numpy()
    counts = np.bincount(words[3], minlength=len(rows))
    for n in set(n_of[n_of > 0]):
        fp, chk, first = grams.ngrams(words, langs, n)
        doc = words[3][first]
        hit = (n_of[doc] == n) & (counts[doc] == n) & (fp == want[doc]) & (chk == check[doc])
        ok[doc[hit]] = True
    return ok


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, seed: int = SEED,
                     chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``(lang, n, phrase, f)`` of all phrases of 1 to ``max_words`` words seen ``min_count`` times in a language;
    the row with n = 0 has the language's number of words.  Written to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL AND text <> ''")
    texts = texts.select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    groups = 2 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(orders: range, marks=None) -> DataFrame:
        sent = texts.mapInPandas(_counter(seed, groups, orders, chunk_words, marks), "g int, blob binary")
        return cut_lineage(sent.groupBy("g").applyInPandas(
            _summed(min_count), "n int, fp long, chk int, f long, d1 long, p1 long, d2 long, p2 long"))

    while True:
        with arrow_batches(spark, 500):
            kept = last = count(range(2))
            for n in range(2, max_words + 1):
                marks = spark.sparkContext.broadcast(_bitmap(last.where(F.col("n") == n - 1)))
                last = count(range(n, n + 1), marks)
                kept = kept.unionByName(last)
            points = F.array_distinct(F.array(F.struct(F.col("d1").alias("d"), F.col("p1").alias("pos")),
                                              F.struct(F.col("d2").alias("d"), F.col("p2").alias("pos"))))
            wanted = kept.select("n", "fp", "chk", "f", F.explode(points).alias("p")).groupBy(F.col("p.d").alias("h")) \
                .agg(F.collect_list(F.struct("n", "fp", "chk", "f", F.col("p.pos").alias("pos"))).alias("at"))
            held = texts.dropDuplicates(["h"]).join(wanted, "h").select("lang", "text", "at")
            read = held.mapInPandas(_reader(seed), "lang string, n int, fp long, chk int, f long, phrase string, ok boolean")
            found = cut_lineage(read.groupBy("n", "fp", "chk").agg(
                F.first("lang").alias("lang"), F.min("phrase").alias("phrase"), F.max("phrase").alias("other"),
                F.min("ok").alias("ok"), F.first("f").alias("f"))
                .select("lang", "n", "phrase", "f", (F.col("ok") & (F.col("phrase") == F.col("other"))).alias("ok")))
        if not found.where("NOT ok").limit(1).count():
            return found.drop("ok")
        drop_lineage(found)
        seed += 1


def scored(phrases: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``(lang, n_words, phrase, a, l, r, score)`` of every candidate: its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = phrases.where(F.col("n") >= 2).select(
        "lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"), words.alias("w"))
    cuts = cuts.select("lang", "n", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"))
    known = phrases.where((F.col("n") >= 1) & (F.col("n") < max_words))
    cuts = skew_join(cuts, known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = skew_join(cuts, known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    a, l, r = [F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")]
    cuts = cuts.withColumn("aa", a * a * F.lit(1_000_000)).withColumn("lr", l * r).withColumn("score", F.expr("aa div lr"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "n", "phrase", "a").agg(best).select("lang", "n", "phrase", "a", "b.l", "b.r", "b.score")


def uncontained(candidates: DataFrame) -> DataFrame:
    """Candidates without a longer candidate that holds their words in a row at least half as often."""
    inner = F.expr("""flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1),
        i -> array_join(slice(split(phrase, ' '), i, m), ' '))))""")
    longer = candidates.where(F.col("n") >= 3).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50)).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 seed: int = SEED, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases."""
    phrases = frequent_phrases(docs, min_count, max_words, seed, chunk_words)
    best = cut_lineage(scored(phrases, max_words))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncontained(best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = phrases.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.drop("n").join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
