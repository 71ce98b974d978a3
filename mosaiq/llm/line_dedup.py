"""Operator 5: fuzzy line dedup by MinHash, in DataFrame operations only.

A line's set is made of character shingles: the ``width`` characters from every character on that has as many
after it, in lower case, without white space at the line's ends; a shorter line is its own only shingle. Texts are
encoded with four bytes a character for that, so a shingle is a slice of bytes. Fourteen minima, each under a hash of
its own (four seeded 64-bit hashes, each turned by 0, 16, 32 and 48 bits), are banded seven by two, which misses a pair of
similarity 0.8 with a chance of 0.08 %.

Pairs of a band's bucket are verified exactly. What is looked at first is a bitmap in which each shingle of a
set flips a bit: the bits in which two bitmaps differ are at most as many as the shingles in which the sets differ, so
a pair with too many can't be similar, and no similar pair is lost. Where buckets have more pairs than a few for each of
their lines, each line is first compared with a centre of each of its buckets, in up to four rounds with different centres,
and the links are united; then the lines of a bucket that lie in different components are joined under that bound, and only
pairs within it are compared by their texts. Components come from distributed union-find.

Of each component of lines the first occurrence stays (smallest doc_id, then smallest line number).

Defined results: a null text is an empty one; lines without a word always stay; rows that share an id are
one document (a line kept for the id is kept in each of its rows); rows with a null id stay as they are and are no
source; empty tables give empty results; all other columns pass unchanged
(``n_lines`` and ``n_dropped`` are replaced, names that begin with two underscores are the operator's own).
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Steps, flagged, sha_of_text, stored
from .graph import components

BANDS, ROWS = 7, 2
#: One for each four minima.
SEEDS = random.Random(5).sample(range(1 << 62), -(-BANDS * ROWS // 4))
#: Rounds, at most, in which lines are compared with a centre of each of their buckets.
CENTRE_ROUNDS = 4
#: All pairs are looked at without a further round if they are so many for each line of a bucket, and no bucket has more lines.
PAIRS_A_LINE, LINES_A_BUCKET = 4, 512
#: 64-bit words of a set's bitmap, a power of two.
BITMAP = 16


def _codes(text: str) -> str:
    return f"encode({text}, 'UTF-32')"


def _last(codes: str, width: int) -> str:
    """Where the last shingle begins, counted in characters from 0."""
    return f"greatest(0, cast(octet_length({codes}) / 4 as int) - {width})"


def _hash(codes: str, at: str, width: int) -> str:
    return f"xxhash64(substring({codes}, 4 * {at} + 1, {4 * width}))"


def _hashes(text: str, width: int) -> str:
    """The hashes of a text's shingles, with repeats. The outer transform holds the encoded text, which is made once."""
    return f"transform(array({_codes(text)}), c -> transform(sequence(0, {_last('c', width)}), i -> {_hash('c', 'i', width)}))[0]"


def _shingles(lines: DataFrame, width: int, side_by_side: int) -> DataFrame:
    """(line, h0, h1, ...): the hashes of all shingles, so many in a row; the last may come again."""
    codes = lines.select("line", F.expr(_codes("plain")).alias("c")).withColumn("last", F.expr(_last("c", width)))
    rows = codes.select("line", "c", "last", F.explode(F.expr(f"sequence(0, last, {side_by_side})")).alias("i"))
    return rows.select("line", *(F.expr(_hash("c", f"least(i + {j}, last)", width)).alias(f"h{j}") for j in range(side_by_side)))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, plain, line) of all lines with a word of documents with an id."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "whole"))
    ends = "substring(cast(whole as binary), {}, 1) in (X'20', X'09', X'0A', X'0B', X'0C', X'0D')"
    # Most lines have nothing to trim, which their first and last bytes tell.
    plain = F.lower(F.expr(rf"if({ends.format(1)} or {ends.format(-1)}, trim(BOTH ' \t\n\u000b\u000c\r' FROM whole), whole)"))
    return lines.select("doc_id", "line_no", plain.alias("plain")).filter("plain != ''").withColumn("line", F.xxhash64("plain"))


def _buckets(lines: DataFrame, width: int) -> DataFrame:
    """(bucket, line): the bands of every distinct line."""
    shingle = _shingles(lines, width, 4)
    # Turned by a seed of its own and mixed again, a hash orders the shingles in four ways: by its bits from any quarter on.
    wide = [F.xxhash64(F.col(f"h{j}").bitwiseXOR(F.lit(seed))).alias(f"x{k}_{j}") for k, seed in enumerate(SEEDS) for j in range(4)]
    shingle = shingle.select("line", *wide)
    turned = lambda x, by: x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))
    orders = [F.least(*(turned(F.col(f"x{k}_{j}"), by) for j in range(4))) for k in range(len(SEEDS)) for by in (0, 16, 32, 48)]
    minima = [F.min(order).alias(f"m{k}") for k, order in enumerate(orders[: BANDS * ROWS])]
    signed = shingle.groupBy("line").agg(*minima)
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    return signed.select("line", F.explode(F.array(*bands)).alias("bucket"))


def _bitmaps(texts: DataFrame, width: int) -> DataFrame:
    """(line, bits): the size of each line's set and its bitmap."""
    sets = texts.select("line", F.explode(F.expr(f"array_distinct({_hashes('plain', width)})")).alias("h"))
    sets = sets.select("line", F.expr(f"cast(h & {BITMAP - 1} as int)").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))").alias("b"))
    words = [F.expr(f"bit_xor(if(w = {k}, b, 0L))").alias(f"b{k}") for k in range(BITMAP)]
    sized = sets.groupBy("line").agg(F.count(F.lit(1)).alias("n"), *words)
    return sized.select("line", F.struct("n", *(f"b{k}" for k in range(BITMAP))).alias("bits"))


def _near(a: str, b: str, percent: int) -> str:
    """False only for sets that can't be similar: sizes too far apart, or bitmaps that differ in too many bits."""
    differ = " + ".join(f"bit_count({a}.b{k} ^ {b}.b{k})" for k in range(BITMAP))
    # Sets of s shared and d other shingles: 100 s >= percent (s + d), where 2 s + d is the sum of their sizes.
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n)"


def _verified(pairs: DataFrame, texts: DataFrame, steps: Steps, width: int, percent: int) -> DataFrame:
    """The similar ones of pairs (u, v, n) of lines, by their whole sets; n is the sum of the sets' sizes."""
    both = pairs.distinct().join(texts.select(F.col("line").alias("u"), F.col("plain").alias("mine")), "u")
    both = both.join(texts.select(F.col("line").alias("v"), F.col("plain").alias("theirs")), "v")
    # The union has n less the shared ones, so each set is made once.
    shared = f"size(array_intersect({_hashes('mine', width)}, {_hashes('theirs', width)}))"
    return steps.stored(both.filter(f"{100 + percent} * {shared} >= {percent} * n").select("u", "v"), "links")


def _crowded(rows: DataFrame) -> bool:
    """Whether buckets have more pairs than may be joined at once; a line's place in its bucket is the number of its pairs with those before, plus 1."""
    lines, pairs, largest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("place") - 1), F.lit(0)), F.coalesce(F.max("place"), F.lit(0))).first()
    return pairs > PAIRS_A_LINE * lines or largest > LINES_A_BUCKET


def line_components(docs: DataFrame, steps: Steps, width: int = 12, percent: int = 80) -> DataFrame:
    """(node, root) for the distinct lines that aren't their component's root."""
    buckets = _buckets(lines_of(docs), width)
    # Buckets of one line are done; a line's neighbours in its bucket are seen while rows stream by in order.
    in_bucket = "over (partition by bucket order by line)"
    buckets = buckets.withColumn("place", F.expr(f"row_number() {in_bucket}")).withColumn("several", F.expr(f"place > 1 or lead(line) {in_bucket} is not null"))
    buckets = steps.stored(buckets.filter("several").select("bucket", "line", "place"), "buckets")
    wanted = steps.stored(buckets.select("line").distinct(), "wanted")
    texts = flagged(lines_of(docs), wanted, "line").filter("__maybe").groupBy("line").agg(F.first("plain").alias("plain"))
    texts = steps.stored(texts.join(wanted, "line", "left_semi"), "texts")
    labelled = steps.stored(buckets.join(_bitmaps(texts, width), "line"), "labelled")
    rest, links = labelled.withColumn("root", F.col("line")), None
    for turn in range(CENTRE_ROUNDS):
        if not _crowded(rest):
            break
        # The order differs by bucket and round, so a line meets many centres. A running first value: nothing is held.
        centre = f"first_value(struct(line, root, bits)) over (partition by bucket order by xxhash64(line, bucket, {turn}), line rows between unbounded preceding and current row)"
        starred = rest.withColumn("c", F.expr(centre)).filter("root != c.root").filter(_near("bits", "c.bits", percent))
        found = _verified(starred.select(F.greatest("line", "c.line").alias("u"), F.least("line", "c.line").alias("v"), F.expr("bits.n + c.bits.n").alias("n")), texts, steps, width, percent)
        roots = components(found if links is None else links.unionAll(found), steps)
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        placed = labelled.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
        # What is left: buckets whose lines lie in different components.
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
        rest = steps.stored(placed.join(mixed, "bucket", "left_semi"), "rest")
    pairs = rest.alias("a").join(rest.alias("b"), F.expr(f"a.bucket = b.bucket and a.line < b.line and a.root != b.root and {_near('a.bits', 'b.bits', percent)}"))
    more = _verified(pairs.select(F.col("a.line").alias("u"), F.col("b.line").alias("v"), F.expr("a.bits.n + b.bits.n").alias("n")), texts, steps, width, percent)
    return components(more if links is None else links.unionAll(more), steps)


def _dropped(docs: DataFrame, steps: Steps, width: int, percent: int) -> DataFrame:
    """(doc_id, __gone): the numbers of the lines that go."""
    roots = line_components(docs, steps, width, percent)
    placed = lines_of(docs).select("doc_id", "line_no", "line").join(roots.withColumnRenamed("node", "line"), "line", "left")
    placed = steps.stored(placed.select("doc_id", "line_no", F.coalesce("root", "line").alias("root")), "places")
    first = placed.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written first, so that the join has two plain shuffles and a hot line's rows can be split.
    first = steps.stored(first.select("root", F.col("at.doc_id").alias("source"), F.col("at.line_no").alias("kept_at")), "first")
    gone = placed.join(first, "root").filter("doc_id != source or line_no != kept_at")
    return stored(gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone")), "gone")


def dedup_lines(docs: DataFrame, width: int = 12, percent: int = 80) -> DataFrame:
    """The documents with only the first line of each component; columns n_lines and n_dropped are added."""
    with Steps(docs.sparkSession) as steps:
        gone = _dropped(docs.select("doc_id", "text"), steps, width, percent)
    mine = flagged(docs, gone.select("doc_id"), "doc_id")
    parts = F.split("text", "\n", -1)
    clean = mine.filter("not __maybe").withColumn("__gone", F.expr("cast(null as array<int>)"))
    dirty = mine.filter("__maybe").join(gone, "doc_id", "left").select(*clean.columns)
    out = clean.unionAll(dirty).withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    left = r"transform(array(split(text, '\n', -1)), p -> array_join(transform(array_except(sequence(0, size(p) - 1), __gone), k -> p[k]), '\n'))[0]"
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.expr(left))).drop("__gone", "__maybe")


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that stays."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_dropped", sha_of_text(F.coalesce("text", F.lit(""))).alias("kept_sha256"))
