"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules whose expressions then run."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """host and path must match as literals (host and its subdomains, path as a prefix); or `pattern` does, on host, path and query."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str | None:
        return self.host + self.path if self.host else None

    def expression(self) -> re.Pattern:
        """Matches from the start of three lines: host, path, query."""
        return re.compile(self.pattern if self.pattern else rf"(?:[^\n]*\.)?{re.escape(self.host)}\n{re.escape(self.path)}", re.ASCII | re.DOTALL)

    def tokens(self) -> list[str]:
        """Tokens that every URL has that the rule matches; a pattern's are its literal words that stand whole."""
        if self.pattern:
            return re.findall(r"\\b([a-z0-9]+)\\b", self.pattern)
        whole = self.path if not self.path or not self.path[-1].isalnum() else self.path.rstrip("".join(set(self.path) & set(_ALNUM)))
        return _tokens(f"{self.host}/{whole}")


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_TOKEN = re.compile("[a-z0-9]+")

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
_HOST, _HOST_END = r"[^\n]*{}[^\n]*\n", r"[^\n]*{}\n"
_PATH, _PATH_END, _QUERY = r"[^\n]*\n[^\n]*{}", r"[^\n]*\n[^\n]*{}\n", r"[^\n]*\n[^\n]*\n(?:[^\n]*&)?{}"
#: What the method itself blocks where no rule fits: expressions on host, path and query (lines), each with a literal word.
EXPRESSIONS = {
    _HOST: [rf"\b{w}\b" for w in ("spam", "pills", "casino", "viagra", "porn", "xxx", "phishing", "malware")]  # words of unwanted sites
    + [r"\bxn\b--", r"\badserver\b\.", r"\btracker\b\."],  # labels in punycode; servers of advertisements and counters
    _HOST_END: [r"[0-9]{4}[^\n]*\.\btop\b", r"[0-9]{4}[^\n]*\.\bxyz\b", r"-[^\n]*-[^\n]*-[^\n]*\.\binfo\b"],  # runs of digits or dashes under cheap domains
    _PATH: [
        r"/\bwp\b-\blogin\b\.", r"/\bxmlrpc\b\.", r"/\bcgi\b-\bbin\b/[^\n]{80}",  # doors of applications, long calls
        r"/\bcalendar\b/[0-9]{4}/[0-9]", r"/\btag\b/[^\n]*/\bpage\b/[0-9]{3}", r"/\bcart\b/\badd\b", r"/\bsession\b/[0-9a-f]{24}",  # pages without end, actions, sessions
    ],
    _PATH_END: [r"\.\bexe\b", r"\.\bapk\b", r"\.\bscr\b"],  # programs
    _QUERY: [r"\bphpsessid\b=[0-9a-z]{16}", r"\breplytocom\b=[0-9]", r"\bredirect\b=http", r"\bsort\b=[^\n]*&\bfilter\b="],  # sessions, answers, ways elsewhere, facets
}
PATTERNS = [Rule("block", pattern=form.format(x)) for form, each in EXPRESSIONS.items() for x in each]


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Without ://, both empty."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.DOTALL)
    return m[1].translate(_LOWER), m[2]


def query_of(url: str | None) -> str:
    """What follows the first ? up to #; empty without ://."""
    m = re.search(r"://[^?#]*\?([^#]*)", url or "", re.DOTALL)
    return m[1] if m else ""


_LOWER = {i: i + 32 for i in range(65, 91)}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[tuple[int, re.Pattern]]]:
    """Each rule under that of its tokens which the URLs hold least often; under '' if it has none."""
    out: dict[str, list[tuple[int, re.Pattern]]] = {}
    for i, r in enumerate(rules):
        key = min(sorted(r.tokens()), key=lambda t: counts.get(t, 0), default="")
        out.setdefault(key, []).append((i, r.expression()))
    return out


def judged(pages: DataFrame, rules: list[Rule] | None = None, patterns: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, one row for each row of pages.

    The longest fitting rule decides (host and path together; the first of equals); where none fits, a matching pattern
    blocks, and all else is allowed. A null url, or one without ://, has an empty host and path, no rule, and is
    allowed. Tokens of rules are counted over all URLs (the counts are as many as the rules' tokens). The rule lists
    are held by every task. Repeated rows and null page_ids are judged row by row; other columns are ignored; urls of any
    length are judged whole; an empty table gives no rows.
    """
    rules, patterns = RULES if rules is None else rules, PATTERNS if patterns is None else patterns
    every = rules + patterns
    known = sorted({t for r in every for t in r.tokens()})
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    held = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce("url", F.lit(""))), F.lit("[a-z0-9]+"), 0), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))
    counts = dict(urls.select(F.explode(held).alias("token")).groupBy("token").count().collect())
    by_token = index(every, counts)
    names, verdicts, size = [r.name for r in every], [r.verdict for r in every], [len(r.host) + len(r.path) for r in every]

    def run(parts):
        for part in parts:
            out = [[], [], [], []]
            for url in part.column(1).to_pylist():
                host, path = split_url(url)
                text, best = f"{host}\n{path}\n{query_of(url)}", None
                for t in {"", *_tokens(text)}:
                    for i, expression in by_token.get(t, ()):
                        if expression.match(text) and (best is None or (-size[i], i) < best):
                            best = (-size[i], i)
                for c, v in zip(out, (host, path, None if best is None else names[best[1]], "allow" if best is None else verdicts[best[1]]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string()) for c in out)], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


#: The rules and patterns of op7 in SQL.
OP7_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^?#]*[?]([^#]*)', 1) AS query FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || chr(10) || path || chr(10) || query, '^(?:PATTERNS)') THEN 'block'
    ELSE 'allow' END AS verdict FROM r
""".replace("PATTERNS", "|".join(r.pattern for r in PATTERNS))
