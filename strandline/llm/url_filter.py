"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is an Aho-Corasick automaton over all terms. A hit counts when no letter or digit of ASCII touches
it; a URL is rejected on one strict term or on ``min_soft`` different soft ones.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of our own choice; a strict one is enough to reject a URL.
STRICT = (
    "casino", "casinos", "escort", "escorts", "farm-links", "gambling", "hentai", "link-farm", "malware", "payday",
    "phishing", "pills", "porn", "porno", "poker", "spam", "spam-farm", "viagra", "warez", "xxx",
)
#: A URL needs several different ones of these to be rejected.
SOFT = (
    "adult", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "coupon", "crypto", "deal", "deals", "dating",
    "discount", "download", "free", "jackpot", "loan", "loans", "offer", "offers", "prize", "promo", "replica", "sale",
    "sex", "slots", "win", "winner",
)
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


class Vocabulary:
    """Counts strict and soft terms in lower-cased URLs; the automaton is built once in each Python worker."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        self.strict, self.soft, self.automaton = tuple(strict), tuple(soft), None

    def __getstate__(self) -> dict:
        return {"strict": self.strict, "soft": self.soft, "automaton": None}

    def hits(self, url: str) -> tuple[int, int]:
        """(different strict terms, different soft terms) of a URL."""
        if not self.strict and not self.soft:
            return 0, 0
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for kind, terms in ((1, self.soft), (0, self.strict)):
                for term in terms:
                    self.automaton.add_word(term, (kind, term))
            self.automaton.make_automaton()
        found: tuple[set, set] = (set(), set())
        low = url.lower()
        for end, (kind, term) in self.automaton.iter(low):
            before, after = low[end - len(term) : end - len(term) + 1] if end >= len(term) else "", low[end + 1 : end + 2]
            if not (_alnum(before) or _alnum(after)):
                found[kind].add(term)
        return len(found[0]), len(found[1])


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def url_verdicts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    min_soft: int = 2,
) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft): one row per row of ``pages``.

    A null URL or one without ``://`` has an empty host and path, fits no rule, and is still judged by its terms
    (null: none). A rule fits its host and all subdomains when the path starts with the rule's; the longest wins.
    Repeated rows are judged alike, an empty table gives an empty result, other columns are not read.
    """
    vocabulary = Vocabulary(strict, soft)

    @F.pandas_udf("n_strict int, n_soft int")
    def count_terms(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vocabulary.hits(u or "") for u in urls], columns=["n_strict", "n_soft"], dtype="int32")

    split = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("u")).withColumns(
        {
            # (?s): a host may hold any character but / ? #
            "host": F.translate(F.regexp_extract("u", r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": F.regexp_extract("u", r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
            "terms": count_terms("u"),
        }
    )
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    judged = F.when((F.col("terms.n_strict") >= 1) | (F.col("terms.n_soft") >= min_soft), "block").otherwise("allow")
    return split.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "terms.n_strict", "terms.n_soft")
