import re
from collections import Counter

from strandline.llm import quality as Q
from strandline.llm import queries
from tests.conftest import SF, oracle, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


PROSE = "It was a long day in the north, and nobody had seen the boats come home. "


def judge(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return sorted(Q.clean_lines(df).collect(), key=lambda r: r.id)


def test_counts(spark, odd):
    texts = [*(r.text for r in odd.collect()), "a b c d e f g h " * 3, "x\nx\n \n \ny\nx", "a b c d e f g h\x0b1 a b c d e f g h 2 b c d e f g h 1", "#|<> é é", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", PROSE * 40]
    for got, text in zip(judge(spark, *texts), texts, strict=True):
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == base(text)
        assert got.base_failed == (got.n_words < 20 or 100 * got.n_repeat_words > 30 * got.n_words)
        assert not (got.base_failed and got.kept)


def test_lines(spark):
    good = "".join(f"Line {i} tells how they went from {i + 1} to {i + 2}.\n" for i in range(6))
    kept, lost, menu, shouted, symbols, notice = judge(
        spark,
        f"Home\n{good}\n\nAll rights reserved.\nLicensed under the MIT License.",
        f"no mark here at all {' '.join(f'on{i}' for i in range(60))}\n{good}",
        "".join(f"a{i} | b{i} | c{i} | d{i}. | e{i}\n" for i in range(6)),
        " ".join(f"AB{i}!!" for i in range(40)),
        " ".join(f"ab{i}***" for i in range(30)) + ".",
        PROSE.replace("day", "day with click here") + " ".join(f"And {i} more." for i in range(40)),
    )
    assert kept.kept and kept.cleaned == good + "\n" and kept.n_failed == 3
    assert lost.cleaned == good and lost.n_failed == 1 and lost.lost_chars == 15 + 10 * 3 + 50 * 4 and not lost.kept and not lost.base_failed
    assert not any(x.kept or x.base_failed for x in (menu, shouted, symbols)) and menu.cleaned == ""
    assert notice.kept and notice.n_failed == 0  # long prose that mentions a phrase


def test_clean_prose_is_kept(spark):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    judged = Q.clean_lines(docs.select("doc_id", "text")).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]


def test_no_python_and_no_shuffle(spark):
    plan = queries.op13_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


def test_empty_table(empty):
    assert Q.clean_lines(empty).collect() == []


def test_oracle(spark):
    assert rows(queries.op13_quality_rules(spark, SF)) == oracle("op13", queries.ORACLES["op13_quality_rules"], SF)
