"""Every registered query with an oracle returns the oracle's rows."""

import decimal
import math

import pytest

from treelens.plans.registry import ORACLES, QUERIES


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())


def test_partitions_of_the_store_sum_to_it(spark, sf_dir):
    census = QUERIES["a4_census"](spark, sf_dir).toPandas()
    objects = QUERIES["sc2_index_records"](spark, sf_dir).toPandas()
    assert census.objects.sum() == len(objects)
    assert census.bytes.sum() == objects.frame_len.sum()


def test_stored_total_plus_delta_is_the_head_total(spark, sf_dir):
    a = QUERIES["a8_incremental_usage"](spark, sf_dir).toPandas().set_index("library_id")["size"]
    b = QUERIES["a1_measure"](spark, sf_dir)
    heads = QUERIES["w6_chain"](spark, sf_dir).filter("pos = 1").join(b, "commit_id").toPandas()
    for r in heads.itertuples():
        assert a[r.library_id] == r.size


def test_read_range_has_every_byte(spark, sf_dir):
    files = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        files[r.conv_id] = files.get(r.conv_id, b"") + (r.text or "").encode()
    got = {r.manifest_id: bytes.fromhex(r.body_hex) for r in QUERIES["j11_read_range"](spark, sf_dir).collect()}
    assert got == {k: b[20:120] for k, b in files.items() if len(b) > 20}
    assert any(not b.isascii() for b in got.values())


def test_listing_has_all_entries_in_order(spark, sf_dir):
    got = [(r.commit_id, r.name) for r in QUERIES["l5_listing"](spark, sf_dir).collect()]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    assert got == sorted(map(tuple, lines.collect()))
