"""Document fingerprints by a homomorphic multiset hash (native expressions only).

A text is cut into paragraph pieces: a piece ends with its line, or after
``WORDS`` words of a longer line.  Pieces keep their white space, so they add up
to the whole text.  SHA-256 of each piece gives

* a check vector of 8 words, summed modulo 2^32: two texts have equal
  fingerprints exactly if they have the same multiset of pieces (up to hash
  collisions), whatever their order;
* a wide vector of 128 lanes of +1 or -1, summed modulo 2^16 (read as signed):
  the cosine of two such sums estimates the overlap of the two multisets.

Both are sums, hence inserting or deleting pieces adds or subtracts vectors
(``combine``); no text has to be read again.

Plan: pieces are exploded and summed in the map task that holds the document
(partial aggregation), two lanes per long, so that one row per text is all that
leaves it.  Defined results: null text is the empty text, whose sums are zero;
two empty texts are alike (1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 8
PIECE = (r"(?:[^ \t\n\r\f\x0B]+[ \t\r\f\x0B]*){1,%d}\n?|[ \t\r\f\x0B]+\n?|\n" % WORDS)
CHECK_WORDS, LANES = 8, 128
CHECK_MOD, LANE_MOD = 1 << 32, 1 << 16
_PAIR = (1 << 32) + 1  # one bit of each of the two 32-bit counters in a long


def _signed(x: Column) -> Column:
    v = F.pmod(x, F.lit(LANE_MOD))
    return F.when(v >= LANE_MOD // 2, v - LANE_MOD).otherwise(v)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per distinct ``keys``: ``(*keys, n_pieces, check, lanes)``; rows of equal keys add up."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    p = rows.select(*keys, F.explode_outer(pieces).alias("_piece")).withColumn("_h", F.sha2("_piece", 256))
    p = p.select(*keys, *[F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_w{i}")
                          for i in range(CHECK_WORDS)])
    p = p.select("*", *[F.col(f"_w{2 * j}").bitwiseOR(F.shiftleft(f"_w{2 * j + 1}", 32)).alias(f"_p{j}")
                        for j in range(2)])
    sums = [F.sum(F.shiftrightunsigned(f"_p{j}", k).bitwiseAND(F.lit(_PAIR))).alias(f"_s{j}_{k}")
            for j in range(2) for k in range(32)]
    agg = p.groupBy(*keys).agg(F.count("_w0").alias("n_pieces"), *sums,
                               *[F.sum(f"_w{i}").alias(f"_c{i}") for i in range(CHECK_WORDS)])
    lanes = []
    for j in range(2):
        for half in (0, 1):
            for k in range(32):
                s = F.coalesce(F.col(f"_s{j}_{k}"), F.lit(0))
                ones = F.shiftrightunsigned(s, 32) if half else s.bitwiseAND(F.lit(CHECK_MOD - 1))
                lanes.append(_signed(2 * ones - F.col("n_pieces")))
    check = [F.pmod(F.coalesce(F.col(f"_c{i}"), F.lit(0)), F.lit(CHECK_MOD)) for i in range(CHECK_WORDS)]
    return agg.select(*keys, "n_pieces", F.array(*check).alias("check"), F.array(*lanes).alias("lanes"))


def fingerprint_struct() -> Column:
    """The vectors as one column, with the squared length that ``likeness`` needs."""
    return F.struct("n_pieces", "check", "lanes", _dot(F.col("lanes"), F.col("lanes")).alias("norm"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Insert (sign 1) the pieces of fingerprint ``b`` into ``a``, or delete them (-1)."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: _signed(x + sign * y))
    return F.struct((a["n_pieces"] + sign * b["n_pieces"]).alias("n_pieces"),
                    F.zip_with(a["check"], b["check"], lambda x, y: F.pmod(x + sign * y, F.lit(CHECK_MOD))).alias("check"),
                    lanes.alias("lanes"), _dot(lanes, lanes).alias("norm"))


def to_hex(fp: Column) -> Column:
    """The fingerprint as a string: check words (8 digits each), then lanes (4 each)."""
    def part(c, digits):
        return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")
    return F.concat(part(fp["check"], 8), part(F.transform(fp["lanes"], lambda x: F.pmod(x, F.lit(LANE_MOD))), 4))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the lane sums (negative: 0)."""
    same = (a["n_pieces"] == b["n_pieces"]) & (a["check"] == b["check"]) & (a["lanes"] == b["lanes"])
    norms = a["norm"].cast("double") * b["norm"].cast("double")
    cos = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(a["lanes"], b["lanes"]) / F.sqrt(norms)))
    return F.when(same, 1.0).when(norms == 0, 0.0).otherwise(F.round(cos, 6))


# -- documents in order of descending id, without a global sort -------------------------------

BLOCK, FANOUT = 512, 4096
MAX_BROADCAST_BLOCKS = 1 << 20   # 16 bytes each


def _successors(blocks: DataFrame) -> DataFrame:
    """``blocks`` (b, head), b distinct: ``(b, next_head)``, the head of the next lower block,
    of the highest one for the lowest.  Groups of at most 2 * FANOUT consecutive numbers are
    ordered by a window each; their ends are resolved one level up."""
    lo, hi = blocks.agg(F.min("b"), F.max("b")).first()
    sup = F.expr(f"b div {FANOUT}")
    w = Window.partitionBy("sup").orderBy(F.col("b").desc())
    inner = blocks.withColumn("sup", sup).withColumn("nxt", F.lead("head").over(w))
    tops = blocks.withColumn("sup", sup).groupBy("sup").agg(F.max(F.struct("b", "head")).alias("t"))
    if lo is None or int(lo / FANOUT) == int(hi / FANOUT):
        ends = tops.select("sup", F.col("t.head").alias("end"))
    else:
        ends = _successors(tops.select(F.col("sup").alias("b"), F.col("t.head").alias("head"))) \
            .select(F.col("b").alias("sup"), F.col("next_head").alias("end"))
    return inner.join(ends, "sup").select("b", F.coalesce("nxt", "end").alias("next_head"))


def with_next(docs: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of (k, text, ...) in blocks of at most BLOCK consecutive ids: adds ``b`` (block), ``rk``
    (place by descending k, then text) and ``ghost``; the last row of a block is a ghost copy of
    the next block's first row, so that every other row's successor is the next of its block."""
    d = docs.select(*cols).withColumn("b", F.expr(f"k div {BLOCK}"))
    heads = d.groupBy("b").agg(F.max("k").alias("head"))
    succ = _successors(heads).select(F.col("b").alias("b"), F.col("next_head").alias("k"))
    if heads.count() <= MAX_BROADCAST_BLOCKS:
        succ = F.broadcast(succ)
    ghosts = d.drop("b").join(succ, "k").select(*cols, "b", F.lit(True).alias("ghost"))
    rows = d.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    w = Window.partitionBy("b").orderBy("ghost", F.col("k").desc(), "text")
    return rows.withColumn("rk", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third replaced by the beginning
    of the next document by descending id): ``(id, n_chars, edited, ...)``.

    Null ids come last; rows with equal ids are ordered by text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                      F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"))
    rows = with_next(src, ["doc_id", "text", "k"])
    n = F.length("text")
    cut = (n - n % 3) / 3
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_cut", cut.cast("int"))
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("_cut")),
                      F.substr("next_text", F.lit(1), F.col("_cut")))
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    variants = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    keys = ["b", "rk", "ghost", "doc_id", "n_chars", "edited_sha256", "kind"]
    v = rows.select(*keys[:-1], F.explode(variants).alias("v")).select(*keys[:-1], "v.kind", F.col("v.t").alias("t"))
    fp = fingerprints(v, keys, "t").select(*keys, fingerprint_struct().alias("fp"))
    w = Window.partitionBy("b").orderBy("rk", "kind")  # text, edited, next text, ...
    out = fp.withColumn("efp", F.lead("fp", 1).over(w)).withColumn("nfp", F.lead("fp", 2).over(w))
    return out.where("kind = 0 AND NOT ghost").select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"),
        to_hex(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"))
