from collections import Counter, defaultdict

import numpy as np
from brute_llm import documents, hard_docs, normalised, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import exact_dedup
from flowlake.llm.exact_dedup import CountingQuotientFilter as Filter

SF = "/root/testdata/sf0.001"


def check(rows, found):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[normalised(text)].append(doc_id)
    want = Counter()
    for doc_id, text, *_ in rows:
        group = groups[normalised(text)]
        keep = min((d for d in group if d is not None), default=None)
        want[doc_id, keep, len(group), doc_id == keep, sha(normalised(text))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()) == want


def test_hard_rows_and_documents(spark):
    docs = hard_docs(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], exact_dedup.exact_duplicates(docs))
    check(documents(spark, SF), exact_dedup.query(spark, SF))


def test_one_row_of_each_text_stays(spark):
    docs = hard_docs(spark)
    stay = exact_dedup.distinct_documents(docs)
    assert stay.columns == docs.columns
    texts = [normalised(r.text) for r in stay.collect()]
    assert sorted(texts) == sorted({normalised(r.text) for r in docs.collect()})
    assert Counter(r.doc_id for r in stay.collect())[6] == 1


def test_empty_table(spark):
    docs = hard_docs(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.distinct_documents(docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2 ** 64 - 1) | st.sampled_from([0, 1, 2 ** 63, 2 ** 64 - 1, 5 << 40]), max_size=30), min_size=1, max_size=5),
       st.integers(4, 8))
def test_merging_filters_loses_nothing(parts, bits):
    slices = defaultdict(list)
    for part in parts:
        for k, piece in Filter.of(np.array(part, np.uint64)).slices(bits):
            slices[k].append(Filter.unpack(*piece.pack()))
    got = Counter()
    for k, pieces in slices.items():
        merged = Filter.merged(pieces)
        values = merged.fingerprints()
        assert (np.diff(values.astype(object)) > 0).all() and all(int(v) >> (64 - bits) == k for v in values)
        got.update(dict(zip(values.tolist(), merged.counts.tolist())))
    assert got == Counter(x for part in parts for x in part)
