"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A URL that no rule decides is blocked when it holds one strict term, or ``soft_needed`` different
soft terms. A term counts only between boundaries: the characters next to it are no ASCII letters
or digits. Nothing is shuffled; the vocabulary and the rules are parameters of fixed size.

Null URLs and URLs without ``://`` have an empty host and path, which no rule fits; the vocabulary
still sees the text of the latter, and a null URL is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from shutterlake.llm.common import ascii_lower, with_columns_from_text

STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirls", "sexcam", "nudes", "malware", "phishing")
SOFT_TERMS = ("adult", "sex", "escort", "casino", "poker", "betting", "slots", "viagra", "pills",
              "dating", "nude", "lottery", "warez", "torrent", "crack", "keygen", "free", "bonus",
              "hot", "cheap")


@dataclass(frozen=True)
class Rule:
    """Decides the URLs of a host and its subdomains whose path starts with ``path``."""

    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and for a URL without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else null."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    null = F.lit(None).cast("string")
    return (null, null) if text is None else (text, verdict)


def vocabulary_hits(df: DataFrame, url: str, strict=STRICT_TERMS, soft=SOFT_TERMS) -> DataFrame:
    """``df`` with n_strict and n_soft: different strict and soft terms between boundaries."""
    weights = {t.encode(): False for t in soft} | {t.encode(): True for t in strict}

    def prepare():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, is_strict in weights.items():
            machine.add_word(term.decode(), (term.decode(), is_strict))
        if weights:
            machine.make_automaton()

        def count(data: bytes | None) -> tuple[int, int]:
            if not data or not weights:
                return 0, 0
            found = {True: set(), False: set()}
            text = data.lower().decode("utf-8", "replace")
            for end, (term, is_strict) in machine.iter(text):
                start, after = end - len(term), text[end + 1:end + 2]
                before = text[start:start + 1] if start >= 0 else ""
                if not _joins(before) and not _joins(after):
                    found[is_strict].add(term)
            return len(found[True]), len(found[False])

        return count

    fields = [StructField("n_strict", IntegerType()), StructField("n_soft", IntegerType())]
    return with_columns_from_text(df, url, fields, prepare)


def _joins(char: str) -> bool:
    return char.isascii() and char.isalnum()


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
               strict=STRICT_TERMS, soft=SOFT_TERMS, soft_needed: int = 2) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft), one row per row of ``pages``."""
    counted = vocabulary_hits(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url", strict, soft
    )
    host, path = url_parts(F.col("url"))
    parts = counted.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_needed), "block").otherwise("allow")
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        "n_strict", "n_soft",
    )
