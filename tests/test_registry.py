import __spark_entry__ as entry
import pytest

DIR = "/root/testdata/sf0.001"


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "corvina"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "corvina.llm" in p.read_text()]


@pytest.mark.parametrize("name", ["L2_bm25", "V3_V4_dense_top_k", "F1_rrf", "E1_E5_evaluate", "G4_call_graph", "G10_communities", "N1_diff_hashes", "E9_metric_intervals", "R1_cascade", "L5_maintained_bm25"])
def test_against_oracle(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(repr([round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert norm(map(tuple, got.select(*cols).collect())) == norm(want)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corvina.runtime import shared_dir

    conf = lambda v: SimpleNamespace(get=lambda k, d=None: v)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a")))
    assert shared_dir(SimpleNamespace(conf=conf("hdfs://x/y/"), sparkContext=None)) == "hdfs://x/y"
