"""Order MinHash fingerprints in DataFrame functions only (operator 9).

A text's k-mers (``K`` words, with marks before the first word) are numbered by
occurrence, so a repeated k-mer counts as often as it occurs. For each of
``SIGNATURES`` orders the ``PICKS`` least k-mers are taken, put back into text
order and hashed as a tuple: two texts agree on a signature when their least
k-mers are the same and stand in the same order, so moved passages count
against likeness, as in edit distance, and not only replaced ones.

The orders are rotations of one 64-bit hash ring: order j compares
``hash(k-mer, occurrence) - j/SIGNATURES of the ring``. Each by itself is a
uniformly random order; one sort of a text's hashes serves them all.

Everything is built-in array functions. In them a value is bound once by
``_let``, since a column named inside a lambda may be computed for each element.
Hashes carry 40 bits of the hash and 24 bits of the position, which makes
their sort one of plain longs; in a text of more than 2**24 words the position
is counted in steps of 2, 4, ... words, so that order is kept.

A word of more than ``LONG_RUN`` characters (text without spaces) counts, from
there on, each character as a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import table, text_or_empty

K = 5
SIGNATURES = 32
PICKS = 2
HEX = 8
_PLACE = (1 << 24) - 1
_SPACE = "[\\x20\\x09-\\x0D]+"
LONG_RUN = 32
_RUN = f"[^\\x20\\x09-\\x0D]{{{LONG_RUN}}}"
#: Rows of a bucket of neighbouring ids, about; and at most so many buckets, whatever the number of rows.
BUCKET_ROWS = 1_000
MAX_BUCKETS = 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _places(n: Column) -> Column:
    """0 to n - 1; empty for none."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _runs(values: Column, same: Callable[[Column], Column]) -> Column:
    """Places in a sorted array where a run of equal ``same`` begins."""
    return F.filter(_places(F.size(values)), lambda j: (j == 0) | (same(F.get(values, j)) != same(F.get(values, j - 1))))


def _k_mers(words: Column) -> Column:
    """Hash of the k-mer that ends at each word, over its place."""
    marks = F.array(*[F.lit(0).cast("long")] * (K - 1))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    k_mer = lambda p: lambda h, i: F.xxhash64(*[F.get(p, i + n) for n in range(K - 1)], h)
    pack = lambda h, i, step: F.shiftleft(F.shiftright(h, 24), 24).bitwiseOR(F.call_function("shiftright", i, step).cast("long"))
    step = lambda hs: F.when(F.size(hs) <= _PLACE, 0).otherwise(F.ceil(F.log2(F.size(hs) / F.lit(float(_PLACE)))).cast("int"))
    return _let(hashed, lambda hs: _let(F.concat(marks, hs), lambda p: _let(step(hs), lambda s: F.transform(hs, lambda h, i: pack(k_mer(p)(h, i), i, s)))))


def _numbered(k_mers: Column) -> Column:
    """Hash of (k-mer, occurrence) over the place of each, sorted by hash."""
    high = lambda x: F.shiftright(x, 24)
    occurrences = lambda starts, n: F.flatten(F.transform(starts, lambda a, g: F.sequence(F.lit(1), F.coalesce(F.get(starts, g + 1), n) - a)))
    again = lambda x, o: F.shiftleft(F.shiftright(F.xxhash64(high(x), o), 24), 24).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
    numbered = lambda s: _let(_runs(s, high), lambda starts: _let(occurrences(starts, F.size(s)), lambda o: F.transform(s, lambda x, j: again(x, F.get(o, j)))))
    return F.sort_array(_let(F.sort_array(k_mers), numbered))


def fingerprint(text: Column) -> Column:
    """``SIGNATURES`` times ``HEX`` hexadecimal digits; texts with the same words have the same ones."""
    words = F.array_remove(F.when(text.rlike(_RUN + "[^\\x20\\x09-\\x0D]"), F.split(text, f"{_SPACE}|(?<={_RUN})")).otherwise(F.split(text, _SPACE)), "")
    bits = SIGNATURES.bit_length() - 1
    bin_of = lambda x: F.shiftright(x, 64 - bits) + SIGNATURES // 2
    high, place = (lambda x: F.shiftright(x, 24)), (lambda x: x.bitwiseAND(F.lit(_PLACE)))

    def signature(ring: Column, first: Column) -> Column:
        picks = F.array_sort(F.transform(F.sequence(F.lit(0), F.least(F.lit(PICKS), F.size(ring)) - 1), lambda i: _let(
            F.get(ring, (first + i) % F.size(ring)), lambda x: F.struct(place(x).alias("p"), high(x).alias("h")))))
        return F.lpad(F.hex(_let(picks, lambda t: F.xxhash64(t["h"])).bitwiseAND(F.lit((1 << 4 * HEX) - 1))), HEX, "0")

    def signatures(ring: Column) -> Column:
        each = lambda starts: F.transform(F.sequence(F.lit(0), F.lit(SIGNATURES - 1)), lambda j: signature(
            ring, F.coalesce(F.get(F.filter(starts, lambda i: bin_of(F.get(ring, i)) >= j), F.lit(0)), F.lit(0))))
        return F.array_join(_let(_runs(ring, bin_of), each), "")

    return _let(words, lambda w: F.when(F.size(w) == 0, F.lit("0" * (HEX * SIGNATURES))).otherwise(_let(_numbered(_k_mers(w)), signatures)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures of two fingerprints."""
    part = lambda s, j: F.substring(s, j * HEX + 1, F.lit(HEX))
    same = lambda ab: F.aggregate(
        F.sequence(F.lit(0), F.lit(SIGNATURES - 1)), F.lit(0), lambda n, j: n + F.when(part(ab["a"], j) == part(ab["b"], j), 1).otherwise(0))
    return _let(F.struct(a.alias("a"), b.alias("b")), same) / F.lit(float(SIGNATURES))


def _list(values: list[int], kind: str) -> Column:
    """A constant array; the optimiser folds the parsing away."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _rank_bounds(rows: DataFrame, buckets: int) -> list[int]:
    """About ``buckets`` quantiles of the column ``_rank``, least first, from a sketch."""
    shares = [n / buckets for n in range(1, buckets)]
    found = rows.agg(F.percentile_approx("_rank", shares, 10 * buckets).alias("q")).first().q if shares else []
    return sorted({int(q) for q in found or []})


def _above(bounds: list[tuple[int, int]]) -> Callable[[Column], Column]:
    """How many of the sorted ``bounds`` are at or below a struct (r, h), by way of every 256th or so."""
    if not bounds:
        return lambda _: F.lit(0)
    each = max(int(len(bounds) ** 0.5), 1)
    structs = lambda part: F.arrays_zip(_list([r for r, _ in part], "decimal(20,0)").alias("r"), _list([h for _, h in part], "bigint").alias("h"))
    coarse, fine = structs(bounds[::each]), structs(bounds)
    below = lambda some, key: F.size(F.filter(some, lambda b: b <= key))
    return lambda key: _let(below(coarse, key), lambda c: F.when(c == 0, 0).otherwise((c - 1) * each + below(F.slice(fine, (c - 1) * each + 1, F.lit(each)), key)))


def bucket_size(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(bucket_rows, -(-rows // MAX_BUCKETS))


def with_next(rows: DataFrame, key: str, text: str, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``next``: a struct of ``carried`` of the next row by descending ``key``, ties by a hash of ``text`` (after the last: the first).

    Rows are dealt into buckets of about ``bucket_rows`` neighbours by
    quantiles of the keys, of which at most ``MAX_BUCKETS`` come to the driver.
    A key with more rows than a bucket is split by the hash; rows that repeat key
    and text should have been put together by ``put_together``. Rows are
    shuffled once, by bucket; the first rows of each bucket are also sent to
    the bucket before it.
    """
    ends = rows.agg(F.count("*").alias("n"), F.min(key).alias("low")).first()
    full = bucket_size(ends.n, bucket_rows)
    # Ascending: a negated key, with null keys (which stand below every other) last.
    last = -(ends.low - 1) if ends.low is not None else 0
    negated = F.coalesce(-F.col(key).cast("decimal(20,0)"), F.lit(last).cast("decimal(20,0)")).cast("decimal(20,0)")
    heavy = {int(r._rank): r.n for r in rows.select(negated.alias("_rank")).groupBy("_rank").agg(F.count("*").alias("n")).filter(F.col("n") > full).collect()}
    hashed = F.when(negated.isin(list(heavy)), F.xxhash64(text)).otherwise(F.lit(0).cast("long")) if heavy else F.lit(0).cast("long")
    bounds = {(r, -(1 << 63)) for r in _rank_bounds(rows.select(negated.alias("_rank")), -(-ends.n // full))}
    for r, n in heavy.items():
        parts = -(-n // full)
        bounds |= {(r, -(1 << 63) + (1 << 64) * i // parts) for i in range(parts)} | {(r + 1, -(1 << 63))}
    place = F.struct(negated.alias("r"), hashed.alias("h"))
    keyed = rows.withColumns({"_place": place, "_bucket": _above(sorted(bounds))(place)})
    # Buckets without rows fall out; the first place of each of the others is known on the driver.
    found = sorted(keyed.groupBy("_bucket").agg(F.min("_place").alias("top")).collect(), key=lambda r: r._bucket)
    number = [0] * (len(bounds) + 1)
    for n, r in enumerate(found):
        number[r._bucket] = n
    count = len(found)
    dealt = keyed.withColumn("_bucket", F.get(_list(number, "int"), F.col("_bucket")))
    top = F.struct(F.get(_list([int(r.top.r) for r in found], "decimal(20,0)"), F.col("_bucket")).alias("r"), F.get(_list([r.top.h for r in found], "bigint"), F.col("_bucket")).alias("h"))
    home = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"), F.lit(False).alias("wrap"))
    ahead = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(count)).alias("b"), F.lit(True).alias("copy"), (F.col("_bucket") == 0).alias("wrap"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("_place") == top, F.array(home, ahead)).otherwise(F.array(home))))
    w = Window.partitionBy("_to.b").orderBy("_to.wrap", "_place", text, "_to.copy")
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(w)).filter("NOT _to.copy").drop("_place", "_bucket", "_to")


def put_together(rows: DataFrame, key: str, full: int) -> DataFrame:
    """Add ``times``: rows of a key with more than ``full`` rows are put together where they repeat each other; others stay, once each.

    At most ``MAX_BUCKETS`` keys have so many rows, as ``full`` is a share of all.
    """
    one = F.lit(1).cast("long").alias("times")
    heavy = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n")).filter(F.col("n") > full).select("_key").toArrow()
    if not heavy.num_rows:
        return rows.select("*", one)
    keys, same = F.broadcast(rows.sparkSession.createDataFrame(heavy)), F.col(key).eqNullSafe(F.col("_key"))
    many = rows.join(keys, same, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("times"))
    return rows.join(keys, same, "left_anti").select("*", one).unionByName(many)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last third of code points replaced by
    as many first ones (or all) of the next row's. Null texts count as empty;
    texts without a word have one common fingerprint. Null ids come last; rows
    with one id follow each other by their texts, where there are over
    ``bucket_rows`` of them by a hash of the text first; a single row is its
    own next. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = rows.count()
    marked = put_together(rows, "doc_id", bucket_size(n, bucket_rows)).withColumn("fingerprint", fingerprint(F.col("text")))
    if not n:
        paired = marked.withColumn("next", F.struct("text", "fingerprint"))
    else:
        paired = with_next(marked, "doc_id", "text", ["text", "fingerprint"], bucket_rows)
    # Of rows put together all but the last are followed by their like.
    paired = paired.withColumn("_last", F.explode(F.when(F.col("times") > 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    paired = paired.withColumn("next", F.when(F.col("_last"), F.col("next")).otherwise(F.struct("text", "fingerprint")))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    times = F.when(F.col("_last"), F.lit(1).cast("long")).otherwise(F.col("times") - 1)
    paired = paired.select("doc_id", times.alias("times"), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    both = paired.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    done = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "times")
    return done.withColumn("times", F.explode(F.array_repeat(F.lit(True), F.col("times").cast("int")))).drop("times")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))
