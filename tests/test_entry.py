"""The driver contract, and agreement of every query with its SQL on the smallest tables."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in sorted(entry.queries()) if not n.startswith("op") and n != "pipeline"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['patternloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 80 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition("/")[0], timeout=120).returncode == 0


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if str(got[c].dtype).startswith("datetime"):
            got[c], want[c] = got[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
    assert rows(got) == rows(want)


#: Queries without SQL that give one row for each row of a table.
EACH = {
    "customer": "A1_isolation_forest A5_robust_cov_csteps A5_robust_covariance A6_one_class C4_gmm C5_average C5_complete C5_ward D3_kernel_components D5_locally_linear H1_autoencoder H3_deep_cluster H4_deep_embedded_clustering H5_contrastive H6_contrastive_cluster M5_dirichlet_labels",
    "embeddings": "C1_kmeans D1_pca_embedding D2_pca_reconstruction D7_laplacian_eigenmaps R7_graph_anomaly_scores",
    "documents": "N5_nmf_transform",
}


#: Run for minutes even on the smallest tables; test_operators.py has their operators on smaller ones.
LONG = ("N4_nmf_topics", "R3_communities")


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql() and n not in LONG])
def test_query_without_sql_gives_its_rows(spark, name):
    # the smallest events are a single batch
    found = entry.queries()[name](spark, SF.replace("0.001", "0.01") if name == "S3_monitor" else SF).toPandas()
    table = next((t for t, names in EACH.items() if name in names.split()), None)
    if table:
        key = next(c for c in ("id", "row_id", "doc") if c in found.columns)
        n = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert found[key].is_unique and 0.8 * n <= len(found) <= n
    assert len(found) and not found.select_dtypes("number").isin([float("inf"), float("-inf")]).any().any()
    if "label" in found.columns and found["label"].dtype.kind == "i":
        assert found["label"].min() >= -1 and found["label"].nunique() > 1
