"""Every query with an oracle against DuckDB, at the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

from parley.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = lambda got, at: Counter(tuple(plain(r[at.index(c)]) for c in columns) for r in got)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    got = QUERIES[name](spark, DIR).collect()
    if name == "logistic_auc":
        assert math.isnan(got[0].auc) or 0 <= got[0].auc <= 1
    elif name == "label_turns":
        assert all(r.intent in ("greeting", "follow_up") for r in got)
    elif name in ("archetype_clusters", "archetype_members"):
        sizes = Counter(r.cluster for r in got)
        assert 1 <= len(sizes) <= 8 and len({r.conversation_id for r in got}) == len(got)
        assert name == "archetype_clusters" or all(r.outcome in ("closed", "human-closed", "lost", "abandoned") for r in got)
    elif name in ("density_clusters", "hierarchical_clusters"):
        sizes = Counter(r.cluster for r in got)
        assert all(n >= 5 for c, n in sizes.items() if c is not None) and len({r.id for r in got}) == len(got)
        assert all(c in {r.id for r in got if r.cluster == c} for c in sizes if c is not None)
    elif name in ("turn_coords", "turn_layout"):
        sizes = Counter(r.cluster_id for r in got)
        assert len({r.turn_id for r in got}) == len(got) and {r.cluster_type for r in got} == {"faq"}
        assert all(math.isfinite(r.x) and math.isfinite(r.y) for r in got) and all(n >= 5 for c, n in sizes.items() if c is not None)
    elif name == "neighbour_graph":
        assert len({(r.id, r.other) for r in got}) == len(got) and all(r.id != r.other and r.d >= 0 for r in got)
        assert max(Counter(r.id for r in got).values()) == 15
    else:
        raise AssertionError(f"{name} has neither SQL nor properties")
