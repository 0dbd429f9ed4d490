import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import pii

#: The contract's patterns, as they stand there.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b@c.d x_y@e.f_z@g.h", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.1", "é 4111 1111 1111 1111 é +1 (743) 555-3824", "4111-1111-1111-1111 0",
    "a." * 4000 + "@" + "b." * 4000 + "c", "1" * 30000, "1 " * 9000, "+" * 3000 + "1 2 3 4 5 6 7 8 9 0 1", "x@y.zé@b.cc",
    "\U0001f600 me@x.org 010.001.0255.1", "+1" * 3000, "4111111111111111@x.yz", "", None,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def stands(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    out = [(m.start(), rank, m.end(), k) for rank, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if stands(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def base(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", "coalesce(text, '') as text")
    return [r.b for r in df.withColumn("spans", pii.base_spans("text")).select("i", pii.joined("spans").alias("b")).orderBy("i").collect()]


def test_hard_texts(spark):
    assert base(spark, HARD) == [brute(t) for t in HARD]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("a1@.+-_ (é4", max_size=50), min_size=1, max_size=30))
def test_any_text(spark, texts):
    assert base(spark, texts) == [brute(t) for t in texts]


def test_terms_that_disclose_are_found(spark):
    rows = [(i, f"Report {i}: the zanzibar clerk wrote to joe@x.org about case number {'abcdefgh'[i]}lpha today") for i in range(6)]
    rows += [(10 + i, f"Report {i}: the clerk wrote to us about the case number today") for i in range(99)] + [(160, "zanzibar and Zanzibars")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in pii.find_personal_data(docs).collect()}
    assert [(s.kind, s.value) for s in found[0].spans] == [("term", "zanzibar"), ("email", "joe@x.org")]
    assert [(s.kind, s.start, s.end) for s in found[160].spans] == [("term", 0, 8)] and not found[10].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "Report 0: the [TERM] clerk wrote to [EMAIL] about case number alpha today" and clean[10] == rows[6][1]


def brute_terms(texts):
    """{term: action} by the definitions, document by document."""
    import math

    word = re.compile(r"[^\W_]+")
    terms = lambda t: {w for w in word.findall(t.lower()) if len(w) > 1 and any(c.isalpha() for c in w)}
    held, around = [terms(t or "") for t in texts], {}
    for d, text in enumerate(texts):
        for kind in PLAIN:
            for m in re.finditer(PLAIN[kind], text or ""):
                if not stands(kind, m.group()):
                    continue
                s, e = m.span()
                before, after = text[max(0, s - pii.WINDOW - 1) : s], text[e : e + pii.WINDOW + 1]
                if s > pii.WINDOW:
                    before = re.sub(r"^[^\W_]+", "", before)
                if len(after) > pii.WINDOW:
                    after = re.sub(r"[^\W_]+$", "", after)
                before, after = re.sub(r"[^\W_]+$", "", before).split("\n")[-1], re.sub(r"^[^\W_]+", "", after).split("\n")[0]
                around.setdefault((kind, m.group().lower()), []).append((d, f"{before} {after}".lower()))
    out = {}
    for places in around.values():
        n_e = len({d for d, _ in places})
        for term in set().union(*(terms(c) for _, c in places)):
            met = [(d, c) for d, c in places if term in terms(c)]
            p = len({d for d, _ in met}) / sum(term in h for h in held)
            if len({c for _, c in met}) >= pii.MIN_CONTEXTS and p >= pii.GENERALISE and math.log2(p * len(texts) / n_e) >= pii.MIN_BITS:
                out[term] = max(p, out.get(term, 0))
    return {t: "remove" if p >= pii.REMOVE else "generalise" for t, p in out.items()}


def test_terms_match_brute_force(spark):
    """Random lines about a few people, with copies, ties, overlapping entities and words that the window cuts."""
    rng = random.Random(4)
    people = [("joe@x.org", ["zanzibar", "clerk7", "ox"]), ("10.0.0.7", ["router", "b52"]), ("+1 (743) 555-3824", ["anna", "lee"]), ("ann@y.net", ["anna", "boss"])]
    filler = ["the", "report", "of", "case", "today", "was", "sent", "to", "office", "with", "a1", "42"]
    texts = []
    for i in range(400):
        words = rng.choices(filler, k=rng.randint(3, 60))
        if i % 8 == 0:
            who, names = people[(i // 8) % len(people)]
            words.insert(rng.randint(0, len(words)), f"{rng.choice(names)} {rng.choice(names)} {who}")
            if rng.random() < 0.3:
                words.insert(rng.randint(0, len(words)), f"{people[0][0]} {people[1][0]}")
        elif rng.random() < 0.02:
            words.insert(0, rng.choice(["anna", "ox", "Router"]))
        texts.append(rng.choice([" ", "\n"]).join(words))
    texts += [texts[8]] * 20 + [texts[0].upper(), None, "", "x" * 200_000 + " joe@x.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' digest", "1 row")
    want = brute_terms(texts)
    assert len(want) >= 4 and set(want.values()) == {"remove", "generalise"}
    found = {r.id: r for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(texts):
        added = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "") if m.group().lower() in want]
        assert [(s.start, s.end) for s in found[i].spans if s.kind == "term"] == added, i
        assert {a.term: a.action for a in found[i].actions or ()} == {t: want[t] for t in {(text or "")[s:e].lower() for s, e in added}}


def test_odd_rows(odd, empty):
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(empty).count() == 0
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))


def test_no_python_in_the_plan(odd):
    plan = pii.find_personal_data(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_are_counted_before_they_meet_terms(spark):
    """A semi join of all words of all texts with the terms made a row for each text that holds one."""
    docs = spark.createDataFrame([("Ann x1 wrote",), ("Ann here",)], "text string")
    found = spark.createDataFrame([(b"a", [(1, f"ann {i}") for i in range(3)])], "digest binary, contexts array<struct<entity: long, context: string>>")
    plan = pii.disclosing_terms(found, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join LeftSemi, \(term", plan)
