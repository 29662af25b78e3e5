import random
from collections import Counter

import numpy as np
from brute_llm import documents, hard_docs, roots, similar

from flowlake.llm import ngram_join
from flowlake.llm.ngram_join import Rule, Trie

SF = "/root/testdata/sf0.001"


def check(rows, found, rule):
    near = similar(rows, rule.width, rule.num, rule.den)
    root = roots(range(len(rows)), [(k, o) for k, (_, links) in enumerate(near) for o in links])
    least = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    want = Counter((rows[k][0], n, least.get(root[k], rows[k][0]), len(links)) for k, (n, links) in enumerate(near))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect()) == want


def near_copies(count):
    random.seed(9)
    base = [f"w{random.randint(0, 400)}" for _ in range(150)]
    rows = []
    for k in range(count):
        text = list(base)
        for _ in range(random.randint(0, 3)):
            text[random.randrange(150)] = f"x{random.randint(0, 10 ** 6)}"
        rows.append((k, " ".join(text[:random.choice([150, 150, 149, 140])]), "en"))
    return rows + [(1000 + k, " ".join(f"y{random.randint(0, 30)}" for _ in range(random.randint(1, 8))), "en") for k in range(60)]


def test_trie_finds_all_links():
    random.seed(10)
    for _ in range(60):
        base = random.sample(range(1000), 40)
        sets = []
        for _ in range(12):
            s = set(base[:random.randint(1, 40)]) | set(random.sample(range(2000), random.randint(0, 5)))
            sets.append(np.array(sorted(s), np.uint64))
        trie = Trie(sets)
        probes = sets + [np.array(sorted(random.sample(range(3000, 4000), 3) + base[:20]), np.uint64)]
        for rule in (Rule(), Rule(3, 60, 100), Rule(5, 1, 100)):
            want = {(p, k) for p, probe in enumerate(probes) for k, s in enumerate(sets)
                    if rule.den * len(set(s.tolist()) & set(probe.tolist())) >= rule.num * len(set(s.tolist()) | set(probe.tolist()))}
            for cells in (1, 10 ** 6):  # one set at a time, and all together
                ngram_join.PROBE_CELLS, before = cells, ngram_join.PROBE_CELLS
                found = list(zip(*(x.tolist() for x in trie.links(probes, rule))))
                ngram_join.PROBE_CELLS = before
                assert len(found) == len(set(found)) and set(found) == want


def test_hard_rows(spark):
    docs = hard_docs(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], ngram_join.similar_documents(docs), Rule())


def test_groups_in_blocks_and_hot_ngrams(spark, monkeypatch):
    rows = near_copies(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    check(rows, ngram_join.similar_documents(docs, Rule(3, 80, 100)), Rule(3, 80, 100))
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0.01)
    check(rows, ngram_join.similar_documents(docs, Rule(3, 80, 100)), Rule(3, 80, 100))
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    check(rows, ngram_join.similar_documents(docs, Rule()), Rule())


def test_documents_with_the_rule_of_the_pipeline(spark):
    rows = documents(spark, SF)
    check(rows, ngram_join.similar_documents(spark.read.parquet(f"{SF}/documents.parquet"), Rule(5, 80, 100)), Rule(5, 80, 100))


def test_empty_table(spark):
    assert ngram_join.similar_documents(hard_docs(spark, [])).count() == 0


def test_large_groups_meet_by_size(spark):
    """One n-gram in sets of many sizes: rows that are sent to blocks stay far below all blocks for all sets."""
    for count in (10_000, 20_000):
        rows = spark.range(count).selectExpr("7L AS leader", "id AS node", "CAST(20 * exp(6.9 * id / %d) AS LONG) AS size" % count, "0L AS first", "X'00' AS bins")
        rows = rows.unionByName(spark.range(5).selectExpr("8L AS leader", "id AS node", "id + 1 AS size", "0L AS first", "X'00' AS bins"))
        dealt = ngram_join._dealt(Rule(), rows, rows.select("leader", "node", "size")).groupBy("leader", "guest").count().collect()
        found = {(r.leader, r.guest): r["count"] for r in dealt}
        assert found.pop((8, False)) == 5
        assert sum(found.values()) < count * -(-count // ngram_join.BLOCK) / 8  # a block of all sets for each of them


def test_bands_part_no_pair():
    for rule in (Rule(), Rule(5, 80, 100), Rule(1, 1, 2), Rule(3, 100, 100)):
        width = max(np.log(rule.den / rule.num) * (1 + 1e-9), 1e-3)
        sizes = np.arange(1, 3000)
        band = np.floor(np.log(sizes) / width)
        largest = np.minimum(rule.den * sizes // rule.num, 2999)
        assert (band[largest - 1] - band <= 1).all()


def test_texts_leave_groups_without_a_size_to_link_with(spark):
    sizes = [(1, 1, 100), (1, 2, 91), (1, 3, 50), (1, 4, 30), (1, 5, 30), (2, 6, 40), (2, 7, 80), (3, 8, 90), (3, 9, 100), (3, 10, 112), (4, 11, 9)]
    rows = spark.createDataFrame(sizes, "leader long, node long, size long")
    assert {(r.leader, r.node) for r in ngram_join._near_sizes(Rule(), rows).collect()} == {(1, 1), (1, 2), (1, 4), (1, 5), (3, 8), (3, 9)}
