"""The numbered queries of this subpackage on the smallest tables: against their SQL, or for form."""

import pytest

from seqloom.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck

WHERE = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "group_id string, domain string", "p4_found": "query_msg_id bigint, response_msg_id bigint", "p5_found": "kind string, owner_id string, source string, first_pos bigint, n_events bigint, duration bigint",
    "p7_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, WHERE)
    if name in COLUMNS:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    if name in ORACLES:
        assert differences(df, duck(WHERE), ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_percentiles_are_certified(spark):
    rows = QUERIES["p6_percentiles"](spark, WHERE).collect()
    # an interpolated percentile of n values may miss its rank by up to one of them
    assert max(r.rank_error - 1 / r.n for r in rows) < 0.01 and {r.scope for r in rows} == {"day", "all"}
