"""Line deduplication: exact by hash, near by a segment-partition edit join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.common import durable, table, text_or_empty
from subspan.plans.components import connected_components

SPACE = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, k, shift): where a line must look for segment k of a line that is `shorter` characters shorter.

    A line is cut into edits + 1 segments; two lines within that many edits share one whole. Before
    segment k at most k edits can lie and after it at most edits - k, of which the difference in
    length takes its part; that bounds how far from its place the segment can be found.
    """
    out = []
    for d in range(edits + 1):
        for k in range(edits + 1):
            for shift in range(max(-k, d - (edits - k)), min(k, d + edits - k) + 1):
                out.append((d, k, shift))
    return out


def _shared(a: Column, b: Column) -> Column:
    """How many characters two strings begin with in common, found by halving steps (up to 2 ** 18)."""
    steps = F.array(*[F.lit(1 << n) for n in range(17, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda p, n: p + F.when(F.substring(a, p + 1, n) == F.substring(b, p + 1, n), n).otherwise(0))
    return F.least(found, F.length(a), F.length(b))


def allowed(length: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """The edits that lines may differ in, of which the shorter one has this length."""
    out = F.lit(0)
    for least, edits in bands:
        out = F.when(length >= least, edits).otherwise(out)
    return out


def _entries(rows: DataFrame, text: Column, bands: tuple[tuple[int, int], ...], keep: tuple[Column, ...], path: Column | None = None, edits: Column | None = None) -> DataFrame:
    """(kept columns, key, own, edits, start, wide, size): each text's index entries (own) and probes, which at no shift and length are entries.

    start and wide tell where the piece stands, size how long the line is that is cut. The edits are
    those given, or follow from that size. Where to look is a constant list by segment, so that one
    small expression computes every key; a segment's surroundings are cut out first, as finding a
    place in a text takes time in proportion to the text.
    """
    ends = [least for least, _ in bands[1:]] + [(1 << 31) - 1]

    def places(of: list[tuple[int, int, int]]) -> Column:
        out = []
        for e, least, below in of:
            for k in range(e + 1):
                own = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(shift).alias("shift")) for d, at, shift in probes(e) if at == k])
                out.append(F.struct(F.lit(e).alias("e"), F.lit(least).alias("least"), F.lit(below).alias("below"), F.lit(k).alias("k"), own.alias("own")))
        return F.array(*out)

    if edits is None:
        most, all_ = bands[-1][1], [(e, least, below) for (least, e), below in zip(bands, ends, strict=True)]
        where = F.when(F.length(text) - most >= bands[-1][0], places(all_[-1:])).otherwise(places(all_))
    else:
        where = F.lit(None)
        for e in sorted({e for _, e in bands}):
            where = F.when(edits == e, places([(e, 0, ends[-1])])).otherwise(where)
    e, k = F.col("_s.e"), F.col("_s.k")
    cut = lambda size, k: F.floor(size * k / (e + 1)).cast("int")
    spread = rows.select(*keep, text.alias("_text"), F.length(text).alias("_n"), (F.lit(0).cast("long") if path is None else path).alias("_path"), F.explode(where).alias("_s"))
    kept = [c for c in spread.columns if c not in ("_text", "_n", "_path", "_s")]
    low = F.greatest(cut(F.col("_n") - e, k) - e, F.lit(0))
    spread = spread.withColumn("_low", low).withColumn("_part", F.substring("_text", F.col("_low") + 1, cut(F.col("_n"), k + 1) + e - F.col("_low")))
    spread = spread.select(*kept, "_n", "_path", "_s", "_low", "_part", F.explode("_s.own").alias("_p")).withColumn("size", F.col("_n") - F.col("_p.d")).where("size >= _s.least AND size < _s.below")
    spread = spread.withColumn("start", cut(F.col("size"), k) + F.col("_p.shift")).withColumn("wide", cut(F.col("size"), k + 1) - cut(F.col("size"), k))
    key = F.xxhash64("_path", e * 16 + k, "size", F.substring("_part", F.col("start") - F.col("_low") + 1, F.col("wide")))
    return spread.select(*kept, key.alias("key"), ((F.col("_p.d") == 0) & (F.col("_p.shift") == 0)).cast("int").alias("own"), e.alias("edits"), "start", "wide", "size")


#: Lines of 12 to 23 characters are near within 1 edit, longer ones within 2, shorter ones not at all.
BANDS = ((12, 1), (24, 2))


def near_links(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, hot: int = 256, levels: int = 3, broadcast_keys: int = 1_000_000) -> DataFrame:
    """(u, v): pairs of line ids within the edits that `bands` allows, enough of them to join whatever is joined.

    bands are (least length, edits) in ascending order, of which the shorter line's length chooses.
    lines has (h, line), repeats allowed. Index entries and probes meet by key in a combined minimum
    and maximum of line hashes, which moves no text and takes any number of repeats of a line; keys
    that one line alone holds are dropped. The lines that meet under the keys left are found by a
    second pass, to which the keys are broadcast if there are at most broadcast_keys of them, else
    joined after a sieve of bounded size, so that texts of other lines do not move. Lines under a key are compared with a banded edit distance and only links leave. A link
    is left out if a third line with a smaller id is linked to both its ends, which keeps the same
    lines connected.

    A key that over `hot` lines hold (a common beginning, say) is searched again without making its
    pairs. All its lines are compared with one of them; those linked to it need not be compared with
    each other. And what lines within so many edits have besides the shared piece, and besides what
    all lines of the key begin and end with, is within so many edits too: the rests are cut, indexed
    and probed in turn, and keys whose lines are linked already are dropped. Keys hot after `levels`
    searches, or whose rests are shorter than the edits, are cut into blocks by hash, each pair of
    blocks on its own; their lines agree in most of their text.
    """
    out = None
    rows = lines.select("h", "line", F.xxhash64("line").alias("label"), F.lit(None).cast("string").alias("rest"), F.lit(None).cast("int").alias("edits"), F.lit(0).cast("long").alias("path"))
    for level in range(levels + 1):
        met = _meet(rows, bands, level == 0, broadcast_keys)
        crowded = durable(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        if level == levels or crowded.isEmpty():
            found = _verified(met, bands, hot)
            return (found if out is None else out.union(found)).distinct()
        rest = F.coalesce("rest", "line")
        rest = F.concat(F.substring(rest, F.lit(1), F.col("start")), F.substr(rest, F.col("start") + F.col("wide") + 1))
        cut = durable(met.join(crowded, "key", "left_semi").withColumn("rest", rest))
        back = F.reverse("rest")
        same = cut.groupBy("key").agg(F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(back).alias("c"), F.max(back).alias("d"), F.min(F.length("rest")).alias("least"), F.min(F.struct("h", "line", "label")).alias("one"))
        same = same.withColumn("begin", _shared(F.col("a"), F.col("b"))).withColumn("end", F.least(_shared(F.col("c"), F.col("d")), F.col("least") - F.col("begin"))).select("key", "begin", "end", "one")
        cut = cut.join(same, "key").withColumn("rest", F.substring("rest", F.col("begin") + 1, F.length("rest") - F.col("begin") - F.col("end")))
        linked = (F.col("h") != F.col("one.h")) & _near(F.col("line"), F.col("one.line"), bands)
        cut = cut.withColumn("linked", linked).withColumn("left", F.col("size") - F.col("wide") - F.col("begin") - F.col("end"))
        cut = durable(cut.withColumn("label", F.when(F.col("linked"), F.col("one.label")).otherwise(F.col("label"))))
        done = met.join(crowded, "key", "left_anti").union(cut.where(F.col("left") <= F.col("edits")).select(met.columns))
        found = _verified(done, bands, hot).union(cut.where("linked").select(F.col("one.h").alias("u"), F.col("h").alias("v")))
        out = found if out is None else out.union(found)
        rows = cut.where(F.col("left") > F.col("edits")).select("h", "line", "label", "rest", "edits", F.col("key").alias("path"))
    raise AssertionError("the last level returns")


def _near(a: Column, b: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """Whether two strings are within the edits that the shorter one's length allows: a banded edit distance that stops beyond them."""
    edits, apart = allowed(F.least(F.length(a), F.length(b)), bands), F.abs(F.length(a) - F.length(b))
    out = F.lit(False)
    for e in sorted({e for _, e in bands}):
        out = F.when((edits == e) & (apart <= e), F.levenshtein(a, b, e) >= 0).otherwise(out)
    return out


def _meet(rows: DataFrame, bands: tuple[tuple[int, int], ...], first: bool, broadcast_keys: int) -> DataFrame:
    """(key, h, own, edits, line, label, rest, start, wide, size): where lines not yet linked meet under a key of which one holds the entry."""
    of = (F.col("line"), bands) if first else (F.col("rest"), bands)
    more = () if first else (F.col("path"), F.col("edits"))
    held = _entries(rows, *of, (F.col("label"),), *more).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("own").alias("own"))
    keys = durable(held.where("low <> high AND own = 1").select("key"))
    n = keys.count()
    met = _entries(rows, *of, (F.col("h"), F.col("line"), F.col("label"), F.col("rest")), *more)
    met = met.join(F.broadcast(keys), "key") if n <= broadcast_keys else _sieved(met, keys, n).join(keys, "key")
    return durable(met.groupBy("key", "h", "start").agg(F.max("own").alias("own"), *[F.max(c).alias(c) for c in ("edits", "label", "wide", "size")], F.min("line").alias("line"), F.min("rest").alias("rest")))


def _sieved(rows: DataFrame, keys: DataFrame, n: int, most: int = 1 << 20) -> DataFrame:
    """rows without nearly all whose key is not among the n keys, so that few texts move to meet them.

    Keys are hashes: their low bits choose one of at most `most` buckets, and of six bits each after
    those a bucket notes four times which values its keys have. A dozen keys a bucket let one row in
    a thousand pass by chance. The buckets are broadcast, whatever the number of keys.
    """
    buckets = min(most, 1 << max(0, (n // 12).bit_length()))
    notes = ("_n0", "_n1", "_n2", "_n3")
    bucket = F.col("key").bitwiseAND(buckets - 1)
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {20 + 6 * i}) & 63 as int))")
    sieve = keys.groupBy(bucket.alias("_bucket")).agg(*[F.bit_or(bit(i)).alias(c) for i, c in enumerate(notes)])
    rows = rows.withColumn("_bucket", bucket).join(F.broadcast(sieve), "_bucket")
    for i, c in enumerate(notes):
        rows = rows.where(F.col(c).bitwiseAND(bit(i)) != 0)
    return rows.drop("_bucket", *notes)


def _verified(met: DataFrame, bands: tuple[tuple[int, int], ...], block: int) -> DataFrame:
    """(u, v): the links among lines under one key; keys of over `block` lines are compared by pairs of blocks."""
    counts = met.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    met = met.join(counts, "key").withColumn("at", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    met = met.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("at")).alias("x"), F.greatest(o, F.col("at")).alias("y")))))
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "pair")  # comparing takes longer than the bytes tell
    groups = met.groupBy("key", "pair").agg(F.sort_array(F.collect_list(F.struct("h", "own", "label", "line"))).alias("m")).where("size(m) > 1")  # two blocks at most

    def linked(a: Column, b: Column) -> Column:
        return F.when((a["label"] == b["label"]) | (a["own"] + b["own"] == 0), False).otherwise(_near(a["line"], b["line"], bands))

    m = F.col("m")
    near = F.transform(m, lambda x, i: F.when(i == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), i - 1), lambda j: linked(x, F.get(m, j)))))
    kept = F.expr("flatten(transform(adj, (s, i) -> transform(filter(s, j -> not arrays_overlap(s, adj[j])), j -> struct(m[j].h as u, m[i].h as v))))")
    return groups.withColumn("adj", near).select(F.explode(kept).alias("e")).select("e.u", "e.v")


def decisions(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, broadcast_lines: int = 1_000_000) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, n_classes, class_id, dropped): what becomes of each document's lines.

    th is the text's hash; documents with equal doc_id and text are one and share a row. Lines are
    split at \\n and trimmed; blank ones are no lines and always stay. Lines with equal text form a
    class, and so do those that `near_links` connects. The first line of a class by doc_id, th and
    position stays, the others are dropped: their positions are `dropped`. class_id is the least
    class hash of the document's lines and n_classes their number. A document without lines has no
    row here. What stays is joined by document, never by class, so that a common line is not one key;
    the classes of near lines are broadcast if there are at most broadcast_lines of them.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th")]
    split = docs.select(*key, F.posexplode(_lines(text_or_empty())).alias("pos", "raw")).select("doc_id", "th", "pos", _trimmed(F.col("raw")).alias("line")).where("line <> ''")
    spots = durable(split.select("doc_id", "th", "pos", F.unhex(F.md5("line")).alias("h")))
    long = split.where(F.length("line") >= bands[0][0]).select(F.unhex(F.md5("line")).alias("h"), "line")
    joined = connected_components(near_links(long, bands)).withColumnRenamed("node", "h")
    few = joined.count() <= broadcast_lines
    spots = spots.join(F.broadcast(joined) if few else joined, "h", "left").select("doc_id", "th", "pos", F.coalesce("component", "h").alias("class"))
    stay = spots.groupBy("class").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first")).groupBy("first.doc_id", "first.th").agg(F.collect_list("first.pos").alias("stay"))
    own = spots.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("all"), F.size(F.collect_set("class")).cast("long").alias("n_classes"), F.min("class").alias("class_id"))
    both = own.alias("o").join(stay.alias("s"), F.col("o.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("o.th") == F.col("s.th")), "left")
    dropped = F.sort_array(F.array_except("all", F.coalesce("stay", F.array().cast("array<int>"))))
    both = both.select("o.doc_id", "o.th", F.size("all").cast("long").alias("n_lines"), "n_classes", "class_id", dropped.alias("dropped"))
    return both.withColumn("n_dropped", F.size("dropped").cast("long"))


def dedup_lines(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """docs with text cut to the lines that stay, and _n_lines, _n_dropped, _n_classes and _class_id.

    Null texts stay null. A document that loses all its lines keeps its blank ones, if any. Rows are
    neither added nor removed; all other columns pass through.
    """
    found = decisions(docs, bands).select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("n_classes").alias("_n_classes"), F.col("class_id").alias("_class_id"), F.col("dropped").alias("_dropped"))
    rows = docs.withColumn("_th_own", F.xxhash64(text_or_empty()))
    rows = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.col("_th_own") == F.col("_th")), "left").drop("_th_own", "_th", "_doc_id")
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains(F.col("_dropped"), i)), "\n")
    rows = rows.withColumn("text", F.when(F.col("_n_dropped") > 0, kept).otherwise(F.col("text"))).drop("_dropped")
    return rows.withColumn("_n_lines", F.coalesce("_n_lines", F.lit(0))).withColumn("_n_dropped", F.coalesce("_n_dropped", F.lit(0))).withColumn("_n_classes", F.coalesce("_n_classes", F.lit(0)))


def op8_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_n_classes").alias("n_classes"), F.md5(text_or_empty()).alias("kept_md5"))


OP8_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT DISTINCT doc_id, text FROM documents))),
d AS MATERIALIZED (SELECT DISTINCT line, length(line) AS n,
       list_transform(['a','b','c','d','e','f','g','h','i','l','m','n','o','r','s','t','u','z',' ','.'], lambda x: length(line) - length(replace(line, x, ''))) AS bag
     FROM l WHERE length(line) >= 12),
e AS MATERIALIZED (SELECT a.line AS u, b.line AS v FROM d a JOIN d b ON b.n BETWEEN a.n AND a.n + 2 AND a.line <> b.line
     WHERE list_sum(list_transform(list_zip(a.bag, b.bag), lambda p: abs(p[1] - p[2]))) <= 4 AND levenshtein(a.line, b.line) <= CASE WHEN a.n < 24 THEN 1 ELSE 2 END),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS a, u AS b FROM s UNION SELECT r.a, s.v FROM r JOIN s ON r.b = s.u),
c AS (SELECT a, min(b) AS class FROM r GROUP BY a),
m AS (SELECT l.*, coalesce(class, line) AS class FROM l LEFT JOIN c ON l.line = c.a),
k AS (SELECT *, line <> '' AND row_number() OVER (PARTITION BY class ORDER BY doc_id, pos) > 1 AS gone FROM m),
g AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped, count(DISTINCT class) FILTER (line <> '') AS n_classes,
             coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_classes, 0) AS n_classes, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""
