"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression with a verdict; its literal tokens (runs of letters and digits that
every match must contain as whole tokens) are counted over all urls, and the rule is filed under
the rarest one. A url is split into tokens, the tokens look up the rules filed under them, and only
those rules run their regular expression. Of the rules that match, the one of highest rank decides
(ties: the smaller name).

Every url is judged by itself in the task that reads it: nothing is shuffled but one count per rule
token and task, so hot hosts and repeated urls do not gather anywhere. The rules are a bounded
parameter that goes to every task; a table of many thousands costs a url only the rules that its own
tokens fetch.

Defined results: a url that is null or has no ``://`` has empty host and path and is allowed; an
empty table gives an empty table; repeated rows are judged alike; a null page_id is kept; of rules of
equal rank the smaller name decides; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import lower_ascii, pages


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # searched for in ``host + path``
    tokens: tuple[str, ...]  # literals that each match contains as whole tokens
    verdict: str
    rank: int
    base: bool = False


def host_rule(verdict: str, name: str) -> Rule:
    """``host/path``: fits the host, its subdomains, and paths that start with the path. Rank: length.

    Tokens of the path count as far as the rule ends them.
    """
    host, _, path = name.partition("/")
    whole = re.split("[^a-z0-9]+", f"{host}/{path}".lower())
    quoted, begun = ("".join("\\" + c if c in ".-+*?()[]{}^$|\\/" else c for c in part) for part in (host, path))
    return Rule(name, rf"^(?:[^/]*\.)?{quoted}/{begun}", tuple(t for t in whole[:-1] if t), verdict, 1000 + len(name), True)


#: The rules of the contract.
BASE_RULES = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
#: Words of hosts, and of steps of paths, that stand for adverts, tracking, spam, gambling, adult pages and malware.
HOST_WORDS = (
    "adnetwork ads adserver adservice adult adx affiliates bets betting camgirls casino casinos doubleclick escort escorts freebets gambling hentai keygen malware "
    "nudes payday phishing pills popunder popup porn porno slots spam sportsbook telemetry track tracker tracking viagra warez webcams xxx"
).split()
PATH_WORDS = "adclick adframe adserver adserving affiliate casino clickthrough phishing popunder porn porno poker spam viagra warez xxx".split()
#: Pairs of words that stand for these only together.
HOST_PAIRS = (("free", "bets"), ("win", "cash"), ("cheap", "meds"), ("hot", "singles"), ("fast", "loans"))
#: The method's own rules, for urls that no base rule fits. Longer evidence ranks higher.
OWN_RULES = (
    *(Rule(f"own:{w}", rf"^[^/]*(?:^|[.-]){w}[.-][^/]*", (w,), "block", 2) for w in HOST_WORDS),
    *(Rule(f"own:{a}-{b}", rf"^[^/]*(?:^|[.-])(?:{a}[.-]{b}|{b}[.-]{a})[.-][^/]*", (a, b), "block", 3) for a, b in HOST_PAIRS),
    *(Rule(f"own:/{w}", rf"^[^/]+/(?:.*/)?{w}(?:[^A-Za-z0-9]|$)", (w,), "block", 1) for w in PATH_WORDS),
)


def url_parts(url) -> tuple:
    """(host, path) of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(host, path):
    """The distinct tokens of an address, letters folded."""
    return F.array_remove(F.array_distinct(F.split(lower_ascii(F.concat(host, path)), "[^a-z0-9]+")), "")


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many urls hold each token of the rules; one row a token, whatever the input."""
    wanted = sorted({t.lower() for r in rules for t in r.tokens})
    held = urls.select(F.explode(F.array_intersect(tokens_of(*url_parts(F.col("url"))), F.array(*map(F.lit, wanted)).cast("array<string>"))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


class Index:
    """Rules under their rarest token; those without a token are under "", which every url looks up."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.filed: dict[str, list[tuple]] = {}
        for r in rules:
            token = min((t.lower() for t in r.tokens), key=lambda t: (counts.get(t, 0), t), default="")
            self.filed.setdefault(token, []).append((-r.rank, r.name, re.compile(r.pattern, re.DOTALL), r.verdict, r.base))

    def judge(self, address: str, tokens: list[str]) -> tuple[str | None, str]:
        """(the base rule's name or None, the verdict)."""
        fetched = [r for t in (*tokens, "") for r in self.filed.get(t, ())]
        for _, name, pattern, verdict, base in sorted(fetched, key=lambda r: r[:2]):
            if pattern.search(address):
                return (name if base else None), verdict
        return None, "allow"


def judge(urls: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES) -> DataFrame:
    """Adds host, path, rule (a base rule's name, else null) and verdict to a table with a ``url``."""
    index = Index(rules, token_counts(urls, rules))
    host, path = url_parts(F.col("url"))
    kept = [f for f in urls.schema.fields if f.name.lower() not in ("host", "path", "rule", "verdict")]
    out = StructType(kept + [StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")])
    n = len(kept)

    def rows(batches):
        for batch in batches:
            hosts, paths, tokens = (batch.column(n + i).to_pylist() for i in range(3))
            found = [index.judge(h + p, t) for h, p, t in zip(hosts, paths, tokens)]
            own = [pa.array([f[i] for f in found], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], *own], out.names)

    read = [urls[f"`{f.name}`"] for f in kept]
    return urls.select(*read, host.alias("_host"), path.alias("_path"), tokens_of(host, path).alias("_tokens")).mapInArrow(rows, out)


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(pages(spark, sf_dir).select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_own = " or ".join(f"regexp_matches(host || path, '{r.pattern}', 's')" for r in OWN_RULES)
SQL = f"""
with parts as (
  select page_id, case when url is not null and position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end rest from pages),
split_up as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
rules(rule, rhost, rpath, verdict) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
ranked as (
  select page_id, host, path, (select max_by(rule, length(rule)) from rules r
    where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) rule from split_up)
select page_id, host, path, rule, coalesce((select r.verdict from rules r where r.rule = ranked.rule),
  case when {_own} then 'block' else 'allow' end) verdict from ranked
"""
