"""Quotation linking: reply trees from quoted passages, and conversations without the quotes.

A message's lines carry quote levels, the number of leading ``>``. A run of lines of one level is a passage;
a passage and each of its lines are normalised (lower case, white space as one space) and hashed. Each hash is
joined to the message that first wrote the text itself: within the same conversation before the quoting message,
else the first one anywhere that comes earlier in the order of (conversation, turn). The message that most of the
level-one text comes from is the parent. Parents point back in that order, so there are no cycles; pointer
doubling finds every message's root and depth in a logarithmic number of joins.

A conversation is a root with its replies, each after its parent. Positions come from one range-sorted table,
whose partitions are numbered, and the first number of each root, so no conversation is gathered in one task.
First writers are aggregated before any join, so a text that thousands of messages share is one row there.

Everything runs as DataFrame functions.

Edge cases: null and empty texts have no lines, quote nothing and have an empty body; messages without a match
are roots; a null conversation or turn is a value of its own that sorts first; rows that repeat a conversation
and turn are one place in the tree, and each keeps its own body; an empty table gives an empty result; further
columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import cut_lineage, drop_scratch

_QUOTE = r"^(?:[ \t]?>)+[ \t]?"
_ATTRIBUTION = r"^(?:On|Am|Le|El) .{1,300}(?:wrote|schrieb|écrit|escribió) ?:\s*$"


def parsed_lines(text: Column) -> Column:
    """array<struct<level, line>> of a text; attributions of quotes are left out."""
    lines = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\r\n|\n|\r"))

    def parse(line: Column) -> Column:
        mark = F.regexp_extract(line, _QUOTE, 0)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace(line, _QUOTE, "").alias("line"))

    return F.filter(F.transform(lines, parse), lambda x: ~((x["level"] == 0) & x["line"].rlike(_ATTRIBUTION)))


def unquoted(lines: Column) -> Column:
    """The lines of level 0 as text, without empty lines at its ends."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s*\n|\s+$", "")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``hash`` and ``size`` of the normalised text; empty ones go."""
    return (df.withColumn(text, normal(F.col(text))).filter(F.col(text) != "")
            .withColumn("hash", F.xxhash64(text)).withColumn("size", F.length(text)).drop(text))


def _written(messages: DataFrame) -> DataFrame:
    """(conv, turn, hash, size) of what messages wrote themselves: their bodies and the lines of these."""
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"])
    return _hashed(messages.select("conv", "turn", F.explode(F.concat(F.array(F.array_join(own, " ")), own)).alias("text")), "text")


def _quoted(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, size) of quoted passages and their lines."""
    quoting = messages.filter(F.exists("lines", lambda x: x["level"] > 0)).dropDuplicates(["id"])
    lines = (quoting.select("conv", "turn", "id", F.posexplode("lines").alias("place", "x"))
             .select("conv", "turn", "id", "place", "x.level", "x.line").filter("level > 0"))
    run = Window.partitionBy("id", "level").orderBy("place")
    lines = lines.withColumn("run", F.col("place") - F.row_number().over(run))
    passages = lines.groupBy("conv", "turn", "id", "level", "run").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("r"))
    texts = F.concat(F.array(F.array_join("r.line", " ")), F.col("r.line"))
    return _hashed(passages.select("conv", "turn", "level", F.explode(texts).alias("text")), "text").distinct()


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, size, from_conv, from_turn) of all quoted passages and lines, the last two null without origin.

    ``messages`` has conv, turn, id and lines.
    """
    first_here = cut_lineage(_written(messages).groupBy("conv", "hash", "size").agg(F.min("turn").alias("here")), "written")
    first = first_here.groupBy("hash", "size").agg(F.min(F.struct("conv", "here")).alias("first"))
    quoted = _quoted(messages)
    inside = quoted.join(first_here, ["conv", "hash", "size"], "left").withColumn("here", F.when(F.col("here") < F.col("turn"), F.col("here")))
    known = inside.join(first, ["hash", "size"], "left")
    earlier = F.struct("first.conv", "first.here") < F.struct(F.col("conv").alias("conv"), F.col("turn").alias("here"))
    return known.select(
        "conv", "turn", "level", "hash", "size",
        F.when(F.col("here").isNotNull(), F.col("conv")).when(earlier, F.col("first.conv")).alias("from_conv"),
        F.when(F.col("here").isNotNull(), F.col("here")).when(earlier, F.col("first.here")).alias("from_turn"))


def _roots(places: DataFrame) -> DataFrame:
    """(conv, turn, root_conv, root_turn, depth) from (conv, turn, parent_conv, parent_turn), by pointer doubling."""
    now = cut_lineage(places.select(
        "conv", "turn", F.coalesce("parent_conv", "conv").alias("root_conv"), F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.when(F.col("parent_conv").isNull(), 0).otherwise(1).cast("long").alias("depth")), "roots")
    while True:
        above = now.select(F.col("conv").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("next_conv"),
                           F.col("root_turn").alias("next_turn"), F.col("depth").alias("more"))
        after = cut_lineage(now.join(above, ["root_conv", "root_turn"]).select(
            "conv", "turn", F.col("next_conv").alias("root_conv"), F.col("next_turn").alias("root_turn"),
            (F.col("depth") + F.col("more")).alias("depth"), "more"), "roots")
        moved = after.filter("more > 0").isEmpty()
        drop_scratch(now)
        now = after.drop("more")
        if moved:
            return now


def _positions(places: DataFrame) -> DataFrame:
    """Adds ``position``, counted from 0 within each root in the order of (conv, turn)."""
    ordered = places.repartitionByRange("root_conv", "root_turn", "conv", "turn").sortWithinPartitions("root_conv", "root_turn", "conv", "turn")
    placed = cut_lineage(ordered.withColumn("_part", F.spark_partition_id())
                         .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    numbered = placed.join(F.broadcast(before), "_part").withColumn("_number", F.col("_before") + F.col("_row"))
    first = numbered.groupBy("root_conv", "root_turn").agg(F.min("_number").alias("_first"))
    return (numbered.join(first, ["root_conv", "root_turn"]).withColumn("position", F.col("_number") - F.col("_first"))
            .drop("_part", "_row", "_before", "_number", "_first"))


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Per row of ``df``: its conversation (root_conv, root_turn), position and depth in it, parent, number and
    deepest level of its quoted passages and how many were linked, role, and body without quotes.

    Conversations and turns are longs; null ones come back as null.
    """
    messages = cut_lineage(df.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(-(1 << 63))).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.col(role_col).alias("role"), parsed_lines(F.col(text_col)).alias("lines"))
        .withColumn("id", F.xxhash64("conv", "turn", "lines")), "messages")
    links = cut_lineage(quote_links(messages), "links")
    weights = links.filter("level = 1 AND from_conv IS NOT NULL").groupBy("conv", "turn", "from_conv", "from_turn").agg(F.sum("size").alias("w"))
    parents = weights.groupBy("conv", "turn").agg(F.max(F.struct("w", "from_conv", "from_turn")).alias("p")).select(
        "conv", "turn", F.col("p.from_conv").alias("parent_conv"), F.col("p.from_turn").alias("parent_turn"))
    quotes = links.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("from_conv").alias("n_linked"), F.max("level").alias("levels"))
    places = cut_lineage(messages.select("conv", "turn").distinct().join(parents, ["conv", "turn"], "left"), "places")
    tree = _positions(_roots(places)).join(places, ["conv", "turn"]).join(quotes, ["conv", "turn"], "left")
    found = messages.select("conv", "turn", "role", unquoted(F.col("lines")).alias("body")).join(tree, ["conv", "turn"])

    def shown(name: str) -> Column:
        return F.when(F.col(name) > -(1 << 63), F.col(name))

    return found.select(
        shown("root_conv").alias("root_conv"), shown("root_turn").alias("root_turn"), "position", "depth",
        shown("conv").alias("conv_id"), shown("turn").alias("turn"), shown("parent_conv").alias("parent_conv"), shown("parent_turn").alias("parent_turn"),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_quoted", "n_linked", "levels")), "role", "body")


def as_mail(conversation: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): each turn as a mail that quotes the turn before, and at the second level the one before that.

    The table of conversations has no quotes; this writes its replies the way mail programs do.
    """
    def earlier(back: int, mark: str) -> DataFrame:
        lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(mark), x))
        return (conversation.filter("text IS NOT NULL").groupBy("conv_id", (F.col("turn") + back).alias("turn"))
                .agg(F.min("text").alias("text")).select("conv_id", "turn", F.array_join(lines, "\n").alias(f"_quote{back}")))

    both = conversation.join(earlier(1, "> "), ["conv_id", "turn"], "left").join(earlier(2, "> > "), ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", "role", F.concat_ws("\n", "_quote2", "_quote1", "text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    mails = as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return conversations(mails)


SQL = r"""
WITH RECURSIVE prev AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
own AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
written AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS t FROM (
    SELECT conv_id, turn, text AS t FROM own UNION ALL SELECT conv_id, turn, unnest(lines) FROM own)),
here AS (SELECT conv_id, t, min(turn) AS turn FROM written WHERE t <> '' GROUP BY ALL),
anywhere AS (SELECT t, min({'c': conv_id, 'n': turn}) AS f FROM here GROUP BY ALL),
q AS (SELECT DISTINCT conv_id, turn, level, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS t FROM (
    SELECT o.conv_id, o.turn, k.level, unnest([p.text] || string_split(p.text, chr(10))) AS t
    FROM (SELECT DISTINCT conv_id, turn FROM own) o, (VALUES (1), (2)) k(level)
    JOIN prev p ON p.conv_id = o.conv_id AND p.turn = o.turn - k.level)),
l AS (SELECT q.*, CASE WHEN h.turn < q.turn THEN q.conv_id WHEN f < {'c': q.conv_id, 'n': q.turn} THEN f.c END AS from_conv,
             CASE WHEN h.turn < q.turn THEN h.turn WHEN f < {'c': q.conv_id, 'n': q.turn} THEN f.n END AS from_turn
      FROM q LEFT JOIN here h ON h.conv_id = q.conv_id AND h.t = q.t LEFT JOIN anywhere a ON a.t = q.t WHERE q.t <> ''),
w AS (SELECT conv_id, turn, from_conv, from_turn, sum(length(t)) AS w FROM l WHERE level = 1 AND from_conv IS NOT NULL GROUP BY ALL),
p AS (SELECT conv_id, turn, max({'w': w, 'c': from_conv, 'n': from_turn}) AS p FROM w GROUP BY ALL),
places AS (SELECT o.conv_id, o.turn, p.p.c AS parent_conv, p.p.n AS parent_turn
           FROM (SELECT DISTINCT conv_id, turn FROM own) o LEFT JOIN p USING (conv_id, turn)),
tree AS (SELECT conv_id, turn, conv_id AS root_conv, turn AS root_turn, 0::BIGINT AS depth FROM places WHERE parent_conv IS NULL
         UNION ALL SELECT c.conv_id, c.turn, t.root_conv, t.root_turn, t.depth + 1 FROM places c JOIN tree t ON c.parent_conv = t.conv_id AND c.parent_turn = t.turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY root_conv, root_turn ORDER BY conv_id, turn) - 1 AS position FROM tree),
n AS (SELECT conv_id, turn, count(*) AS n_quoted, count(from_conv) AS n_linked, max(level) AS levels FROM l GROUP BY ALL)
SELECT root_conv, root_turn, position, depth, conv_id, turn, parent_conv, parent_turn, coalesce(n_quoted, 0) AS n_quoted,
       coalesce(n_linked, 0) AS n_linked, coalesce(levels, 0)::BIGINT AS levels, role, regexp_replace(regexp_replace(text, '^\s*\n', ''), '\s+$', '') AS body
FROM own JOIN placed USING (conv_id, turn) JOIN places USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)
"""
