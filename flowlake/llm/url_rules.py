"""URL filtering by curated rules and by association rules that FP-growth mines from labelled URLs.

A URL becomes a set of tokens: labels of its host, segments of its path with digits generalised, extension,
query keys, fragment. Spark's FP-growth finds token combinations that go with a label; rules below the support
or confidence, and rules that a shorter one covers, are pruned. What remains is an inverted index: each rule
lies under its rarest token, and a token set meets only rules under its own tokens. Token sets are judged once,
however many URLs share them, and the verdicts return to the URLs by the set's hash.

Curated rules come first: a rule of host and path fits its host and all subdomains if the URL's path starts with
the rule's; the longest wins. URLs that no curated rule fits get the verdict of the mined rule of highest
confidence, then support, then most tokens, then block before allow; without one they are allowed.

Labels name documents; a page gets the label of a document whose letters and digits are those of its article without
the main heading. Ids of pages and documents are unrelated and never compared.

Everything runs as DataFrame operations and Spark ML.

Edge cases: a null URL or one without ``://`` has empty host, path and tokens and is allowed; repeated rows are
rows of their own; with no labelled URL nothing is mined; an empty table gives an empty result; further columns
are passed on.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.routing import numbered
from flowlake.session import cut_lineage

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
#: Judged token sets that are broadcast (about 40 bytes each); more are joined by hash.
BROADCAST_SETS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABELS = {"block": "=block", "allow": "=allow"}


class CuratedRule(NamedTuple):
    """A verdict for a host with its subdomains and paths with a prefix."""
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL; empty without ``://``."""
    def marked(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))

    def general(text: Column) -> Column:
        return F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[0-9]+", "#")

    text = F.coalesce(url, F.lit(""))
    path = path_of(url)
    after = F.regexp_extract(text, r"^(?s:.*?)://[^?#]*([?][^#]*)?(#(?s:.*))?$", 1)
    keys = F.transform(F.split(F.substring(after, 2, 1 << 30), "&"), lambda x: F.split(x, "=")[0])
    fragment = F.regexp_extract(text, r"^(?s:.*?)://[^#]*(#)", 1)
    extension = F.regexp_extract(path, r"[.]([A-Za-z0-9]{1,8})$", 1)
    tokens = F.concat(
        marked("host", F.split(host_of(url), "[.]")),
        marked("path", F.split(general(F.regexp_replace(path, r"[.][A-Za-z0-9]{1,8}$", "")), "/")),
        marked("type", F.array(general(extension))), marked("query", F.transform(keys, general)), marked("fragment", F.array(fragment)))
    return F.sort_array(F.array_distinct(tokens))


def curated(rules: list[CuratedRule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # the last that is wrapped is tried first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, token) from rows of (tokens, verdict); ``token`` is the rarest of the antecedent.

    The number of rules is bounded by the support, not by the rows.
    """
    spark = labelled.sparkSession
    label = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])
    items = labelled.filter(F.size("tokens") > 0).select(F.concat("tokens", F.array(label[F.col("verdict")])).alias("items"))
    if items.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, token string")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0].isin(*_LABELS.values()) & (F.col("lift") > 1))
    rules = cut_lineage(rules.select(
        F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 10).alias("verdict"), "confidence", "support"), "rules")
    frequency = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    placed = rules.withColumn("token", F.explode("antecedent")).join(frequency, "token")
    rarest = placed.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("r"))
    index = cut_lineage(rarest.select("antecedent", "verdict", "confidence", "support", F.col("r.token").alias("token")), "index")
    # a rule is covered by one with part of its tokens, the same verdict and no less confidence
    longer = index.withColumn("own", F.explode("antecedent"))
    shorter = index.select(F.col("antecedent").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("as_sure"), F.col("token").alias("own"))
    covered = (longer.join(shorter, "own").filter((F.col("same") == F.col("verdict")) & (F.col("as_sure") >= F.col("confidence"))
                                                  & (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
               .select("antecedent", "verdict").distinct())
    return cut_lineage(index.join(covered, ["antecedent", "verdict"], "left_anti"), "pruned")


def judge_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_id, mined) of the token sets (set_id, tokens) that a rule fits, by the inverted index."""
    candidates = sets.withColumn("token", F.explode("tokens")).join(rules, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict"))
    return candidates.groupBy("set_id").agg(best.alias("b")).select("set_id", F.col("b.verdict").alias("mined"))


def judge(urls: DataFrame, rules: list[CuratedRule], labels: DataFrame | None = None, url_col: str = "url",
          id_col: str | None = None, **options) -> DataFrame:
    """``urls`` with ``_host``, ``_path``, ``_rule``, ``_verdict``, ``_mined``.

    Labelled URLs are those that a curated rule fits and, with ``labels`` of (id, verdict), those whose
    ``id_col`` it names; a curated verdict goes before a label.
    """
    plain, name = numbered(urls)
    url = F.col(name[url_col])
    parsed = (plain.withColumn("_host", host_of(url)).withColumn("_path", path_of(url))
              .withColumn("_fit", curated(rules, F.col("_host"), F.col("_path"))).withColumn("_tokens", url_tokens(url)))
    known = parsed.select(*([F.col(name[id_col]).alias("_id")] if id_col else []), "_fit", "_tokens")
    if labels is not None:
        known = known.join(labels.select(F.col("id").alias("_id"), F.col("verdict").alias("_label")), "_id", "left")
    else:
        known = known.withColumn("_label", F.lit(None).cast("string"))
    labelled = cut_lineage(known.select(F.col("_tokens").alias("tokens"), F.coalesce("_fit.verdict", "_label").alias("verdict"))
                           .filter("verdict IS NOT NULL"), "labelled")
    mined = mine(labelled, **options)
    sets = parsed.select(F.col("_tokens").alias("tokens")).distinct().withColumn("set_id", F.xxhash64("tokens"))
    judged = cut_lineage(judge_sets(sets, mined), "judged")
    few = judged.count() <= BROADCAST_SETS
    found = parsed.withColumn("set_id", F.xxhash64("_tokens")).join(F.broadcast(judged) if few else judged, "set_id", "left")
    own = found.select(*plain.columns, "_host", "_path", F.col("_fit.rule"), F.coalesce("_fit.verdict", "mined", F.lit("allow")), "mined")
    return own.toDF(*urls.columns, "_host", "_path", "_rule", "_verdict", "_mined")


def text_key(text: Column) -> Column:
    """A digest of the letters and digits of a text; null if it has none."""
    letters = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
    return F.when(letters != "", F.sha2(letters, 256))


def article_of(html: Column) -> Column:
    """What the page's first article or main element holds without main heading, scripts, tags and character references; empty
    without such an element."""
    inside = F.regexp_extract(html, r"(?is)<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\z)", 2)
    text = F.regexp_replace(inside, r"(?is)<!--.*?(?:-->|\z)|<(script|style|h1)\b[^>]*>.*?(?:</\1\s*>|\z)|<[^>]*>", " ")
    return F.regexp_replace(text, r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", " ")


def document_verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, verdict) by the text key of the labelled documents; of several labels of a text the strictest."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow")
    keys = documents.select("doc_id", text_key(F.col("text")).alias("id")).filter("id IS NOT NULL")
    return keys.join(labels.select("doc_id", bad.alias("verdict")), "doc_id").groupBy("id").agg(F.max("verdict").alias("verdict"))


#: The rules of the query, as its contract gives them.
RULES = [CuratedRule("block", "net", "/"), CuratedRule("allow", "example.net", "/en/"),
         CuratedRule("block", "example.com", "/de/"), CuratedRule("allow", "org", "/fr/")]


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    own = F.concat(F.lit("-"), F.col("page_id").cast("string"))  # no document's key, and not the same for all
    keyed = pages.select("page_id", "url", F.coalesce(text_key(article_of(F.col("html"))), own).alias("key"))
    verdicts = document_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = judge(keyed, RULES, verdicts, id_col="key")
    return found.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                        F.col("_verdict").alias("verdict"), F.col("_mined").alias("mined"))
