import hashlib
import re

import pytest

from strandline.llm import fill_in_middle as M
from strandline.llm import queries
from tests.conftest import SF, oracle, rows


def plainly(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows(spark, odd):
    texts = [(100 + i, t) for i, t in enumerate(["<P>x", "a<S", "b<M> c", "😀é x😀", "<<P", "<", "a" * 5000, "퟿\n\t\0 ab", "ab1cd"] * 20)]
    df = odd.select("doc_id", "text", "id", "row").unionByName(spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, id int, row int"))
    given = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in M.fill_in_middle(df).collect()]
    assert sorted(got, key=repr) == sorted((plainly(*g) for g in given), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restored(spark, odd):
    cut = M.fill_in_middle(odd, plain=100, spm=50)
    assert sorted(map(repr, (r[0] for r in cut.select(M.restore(cut.output, cut.form)).collect()))) == sorted(repr(r.text or "") for r in odd.collect())


def test_empty_table(empty):
    assert M.fill_in_middle(empty).collect() == []


@pytest.mark.parametrize("seed", [2, 77])
def test_seeds(spark, seed):
    df = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id, ' é '), cast(id % 7 as int)) as text")
    assert sorted(map(tuple, M.fill_in_middle(df, seed=seed).collect())) == sorted(plainly(r.doc_id, r.text, seed) for r in df.collect())


def test_units_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.op12_fill_in_middle(spark, SF)
        plan.collect()
        tree = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = tree[: tree.find("Initial Plan")] if "Initial Plan" in tree else tree
    # one exchange of texts, used three times
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", final)) == 1 + final.count("ReusedExchange")
    assert final.count("ReusedExchange") == 2


def test_oracle(spark):
    assert rows(queries.op12_fill_in_middle(spark, SF)) == oracle("op12", queries.OP12_SQL, SF)
