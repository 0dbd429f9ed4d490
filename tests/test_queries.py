"""Every core query against its SQL oracle on the smallest tables; the others against plain Python."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.plans import queries, streams  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES
from tests.conftest import SF, oracle, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert rows(df) == oracle(name, ORACLES[name], SF)
    else:
        check = {
            "rag_answer": lambda: known_sources(df, QUERIES["ast_chunks"](spark, SF)),
        }
        assert check[name]()


@pytest.mark.parametrize("name", ["skeleton_lines", "fallback_chunks"])
def test_odd_lines(spark, tmp_path, name):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", " ", "@", "@a\n@b", "\n\n", None, *(t for e in ends for t in (e, f"x{e}y", f"x{e}", f"@a{e}b", f"@a\n{e}b", f"p{e}\nq\n"))]
    docs = {"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    assert rows(QUERIES[name](spark, str(tmp_path))) == oracle("", ORACLES[name], str(tmp_path))


def known_sources(df, chunks):
    known = {(c.file, c.name, c.start_line, c.end_line) for c in chunks.collect()}
    (answer,) = df.collect()
    return len(answer.sources) == 5 and {(x.file, x.name, x.start_line, x.end_line) for x in answer.sources} <= known and answer.sources[0].file in answer.answer


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_topk_is_one_pass(spark):
    plan = QUERIES["vector_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_file_filter_is_pushed_down(spark):
    plan = QUERIES["job_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan and "EqualTo(o_orderkey,7)" in plan
