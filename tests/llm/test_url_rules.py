import itertools
from collections import Counter

import pytest

from flowlake.llm import host_paths, url_rules
from flowlake.llm.url_rules import RULES

SF = "/root/testdata/sf0.001"
URLS = ["http://a.example.net/en/1", "https://A.Example.NET/de/2", "http://net/x", "http://xnet/x", "http://b.example.com/de/3#top",
        "http://b.example.com/en/3", "http://c.org/fr/", "http://org/fr/x?y=1", "http://c.org/fr", "http://a.net?x/", "http://a.net", "nothing",
        "", None, "ftp://u@b.org:80/fr/9.html", "http://x.org/http://y.net/en/", "://example.net/en/"]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule_of(url):
    host, path = parsed(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def check(rows):
    for r in rows:
        rule = rule_of(r.url)
        assert (r._host, r._path) == parsed(r.url)
        assert r._rule == (rule and rule.host + rule.path)
        assert r._verdict == (rule.verdict if rule else r._mined or "allow")


def test_curated_rules_and_hard_rows(spark):
    urls = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS + URLS[:2])], "page_id long, url string, tokens string, mined string")
    found = url_rules.judge(urls, RULES)
    assert found.count() == len(URLS) + 2
    check(found.collect())
    assert url_rules.judge(urls.filter("false"), RULES).count() == 0


def test_whole_table(spark):
    found = url_rules.judge(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), RULES)
    check(found.collect())


def test_mined_rules_against_all_combinations(spark, monkeypatch):
    rows = ([(["h:a", "p:x"], "block")] * 12 + [(["h:a", "p:y"], "allow")] * 9 + [(["h:b", "p:x", "q:r"], "allow")] * 10
            + [(["h:b", "q:r"], "allow")] * 4 + [(["h:c"], "block")] * 5 + [(["h:c"], "allow")])
    got = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support, r.token)
           for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    tokens = sorted({t for x, _ in rows for t in x})
    frequency = Counter(t for x, _ in rows for t in x)
    share = Counter(v for _, v in rows)
    rules = {}
    for size in (1, 2, 3):
        for part in itertools.combinations(tokens, size):
            has = [v for x, v in rows if set(part) <= set(x)]
            for verdict in ("block", "allow"):
                n = has.count(verdict)
                if n / len(rows) >= 0.05 and n / len(has) >= 0.8 and n / len(has) > share[verdict] / len(rows):
                    rules[part, verdict] = n / len(has), n / len(rows)
    kept = {k: v for k, v in rules.items() if not any(
        k2[1] == k[1] and set(k2[0]) < set(k[0]) and v2[0] >= v[0] for k2, v2 in rules.items())}
    assert got.keys() == kept.keys()
    for key, (confidence, support, token) in got.items():
        assert (confidence, support) == pytest.approx(kept[key]) and token in key[0]
        assert frequency[token] == min(frequency[t] for t in key[0])
    sets = spark.createDataFrame([(1, ["h:a", "p:x", "z"]), (2, ["h:b", "q:r"]), (3, ["z"]), (4, [])], "set_id long, tokens array<string>")
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8)
    assert {r.set_id: r.mined for r in url_rules.judge_sets(sets, mined).collect()} == {1: "block", 2: "allow"}


def test_labels_generalise_to_other_urls(spark, monkeypatch):
    urls = spark.createDataFrame([(k, f"http://{'spam' if k % 2 else 'good'}.example.org/en/{k}") for k in range(80)], "page_id long, url string")
    labels = spark.createDataFrame([(k, "block" if k % 2 else "allow") for k in range(40)], "id long, verdict string")
    want = {r.page_id: "block" if r.page_id % 2 else "allow" for r in urls.collect()}
    for limit in (url_rules.BROADCAST_SETS, 0):
        monkeypatch.setattr(url_rules, "BROADCAST_SETS", limit)
        found = url_rules.judge(urls, RULES, labels, id_col="page_id").collect()
        assert {r.page_id: r._verdict for r in found} == want


def test_labels_of_documents_reach_pages_by_text(spark):
    """Page ids and document ids are unrelated: a page has the label of the document whose text it shows."""
    page = "<title>x</title><div class='ad'>no</div><%s class='a'><h1>One</h1><script>no</script><p>One &amp; two<br><!-- no --><b>th</b>ree é</%s>no"
    pages = spark.createDataFrame([(1, page % ("article", "article")), (2, page % ("main", "main")), (3, "<p>one two"), (4, None)], "page_id long, html string")
    documents = spark.createDataFrame([(7, "One & two\nthree é"), (8, "One  & two three é"), (1, "other"), (3, "!"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (1, 0, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    verdicts = {r.id: r.verdict for r in url_rules.document_verdicts(documents, labels).collect()}
    keys = {r.page_id: r.key for r in pages.select("page_id", url_rules.text_key(url_rules.article_of(pages.html)).alias("key")).collect()}
    assert sorted(verdicts.values()) == ["block", "block"]  # the stricter one of both copies, and the other text
    assert {k: verdicts.get(v) for k, v in keys.items()} == {1: "block", 2: "block", 3: None, 4: None}


def test_query_learns_from_texts_not_ids(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: "".join(c for c in r.text or "" if c.isalnum()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    strict = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        strict[texts[r.doc_id]] = max(strict.get(texts[r.doc_id], ""), "block" if r.quality == 0 or r.toxic == 1 else "allow")
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parsed_page = host_paths.parse(r.html)
        blocks = host_paths.blocks_at(parsed_page, host_paths.best_container(parsed_page)[0])
        rows.append((r.page_id, r.url, strict.get("".join(c for k in blocks[1:] for c in parsed_page.blocks[k][0] if c.isalnum()))))
    assert sum(v is not None for *_, v in rows) > 50
    urls = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2]], "id long, verdict string")
    want = {r.page_id: (r._verdict, r._mined) for r in url_rules.judge(urls, RULES, labels, id_col="page_id").collect()}
    assert {r.page_id: (r.verdict, r.mined) for r in url_rules.query(spark, sf).collect()} == want
