"""URL filters: host and path rules, then a filter list whose rules are found by their rarest literal token.

The list has the syntax of ad-block lists: || begins a host or a label of one, | is the start or the end, * anything, ^ a
separator or the end, @@ an exception, /.../ a regular expression, ! a comment. A token is a whole run of a-z and 0-9. Which
tokens every fitting url must hold is read off the rule itself: runs that a literal, an anchor or a separator bounds
on both sides. A rule is filed under the one of them that fewest rules hold; a url's tokens fetch its candidates, and
only their regular expressions run, so the work for a url does not grow with the number of such rules. A rule without a
certain token (a regular expression, a run next to * or to an open end) is tested on every url.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from erlink.llm.common import map_batches

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class PathRule:
    """Fits a host and its subdomains, and paths that start with path. The longest host + path wins."""

    verdict: str
    host: str
    path: str


#: The rules of the task.
PATH_RULES = (
    PathRule("allow", "org", "/"),
    PathRule("block", "example.org", "/es/"),
    PathRule("block", "example.org", "/en/1"),
    PathRule("allow", "com", "/fr/"),
    PathRule("block", "com", "/de/"),
)

#: Own choice: what the list is made of. Labels and hosts of spam and adverts, pages for machines, files that are no text.
SPAM_LABELS = "cheap-pills cheap-meds discount-pills online-pharmacy payday-loans quick-loans free-ringtones replica-watches essay-writers seo-links link-farm spam-farm content-farm click-farm adult-chat adult-dating free-gift-cards win-prizes hot-singles work-from-home-jobs".split()
AD_LABELS = "adserver adservice ads adclick banners tracker tracking telemetry pixel popunder clickserve affiliates".split()
AD_HOSTS = "doubleclick.net googlesyndication.com googleadservices.com adnxs.com criteo.com taboola.com outbrain.com scorecardresearch.com quantserve.com rubiconproject.com pubmatic.com openx.net casalemedia.com moatads.com adsrvr.org advertising.com zedo.com popads.net revcontent.com mgid.com".split()
MACHINE_PAGES = "login logout signin signout signup register cart checkout basket wishlist wp-admin wp-login xmlrpc cgi-bin phpmyadmin password-reset unsubscribe captcha webmail oauth".split()
FILE_TYPES = "exe msi dmg apk iso zip rar 7z tar gz tgz bz2 jar jpg jpeg png gif webp bmp ico svg mp3 mp4 avi mov wmv flv webm wav ogg ttf woff woff2 css swf bin torrent".split()
SPAM_WORDS = "casino poker roulette jackpot viagra".split()

FILTERS = (
    *(f"||{x}." for x in (*SPAM_LABELS, *AD_LABELS)),
    *(f"||{x}^" for x in AD_HOSTS),
    *(f"/{x}{end}" for x in MACHINE_PAGES for end in ("^", ".")),
    *(f".{x}{end}" for x in FILE_TYPES for end in ("|", "?", "#")),
    *(rf"/^[a-z]+:\/\/[^\/?#]*{x}[.-]/" for x in SPAM_WORDS),
    "@@/login/help^",
    "@@||ads.txt.",
)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What * and ^ and || stand for; a separator is none of the characters that names and values are made of.
_ANY, _SEPARATOR, _LABEL = "(?s:.*)", "(?:[^a-z0-9_.%-]|{end})", r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class Filter:
    """A rule of the list over the url, A-Z lower-cased: its verdict, its regular expression with {end} for the end of the url, its certain tokens."""

    verdict: str
    pattern: str
    tokens: frozenset[str]

    def regex(self, end: str = r"\Z") -> str:
        """The expression in the words of an engine: \\Z is the very end for Python, \\z for RE2."""
        return self.pattern.replace("{end}", end)


def parse_filter(line: str) -> Filter | None:
    """The rule of a line; None for a comment, a blank line or a section head. Options ($third-party and so on) are not known."""
    line = line.strip().translate(_LOWER)
    if not line or line[0] in "![":
        return None
    verdict = "allow" if line.startswith("@@") else "block"
    line = line.removeprefix("@@")
    if len(line) > 2 and line[0] == line[-1] == "/":
        return Filter(verdict, line[1:-1].replace("\\/", "/").replace("$", "{end}"), frozenset())
    if "$" in line:
        raise ValueError(f"options are not supported: {line}")
    if line.startswith("||"):
        out, body, sure = [_LABEL], line[2:], True
    elif line.startswith("|"):
        out, body, sure = ["^"], line[1:], True
    else:
        out, body, sure = [], line, False  # sure: a token cannot reach beyond this place to the left
    closed = body.endswith("|")
    tokens: set[str] = set()
    run, run_sure = "", False

    def end_run(bounded: bool) -> None:
        nonlocal run
        if run and run_sure and bounded:
            tokens.add(run)
        run = ""

    for ch in body.removesuffix("|"):
        if TOKEN.fullmatch(ch):
            if not run:
                run_sure = sure
            run += ch
            out.append(ch)
            continue
        end_run(ch != "*")
        sure = ch != "*"
        out.append(_ANY if ch == "*" else _SEPARATOR if ch == "^" else re.escape(ch))
    end_run(closed)
    return Filter(verdict, "".join(out) + ("{end}" if closed else ""), frozenset(tokens))


def parse_list(lines: Iterable[str]) -> list[Filter]:
    return [f for f in map(parse_filter, lines) if f]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or no "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(_LOWER), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


class RuleIndex:
    """Path rules by host, filters by their rarest token. Of filters that fit, exceptions win, whatever their order."""

    def __init__(self, path_rules=PATH_RULES, filters: Iterable[str] = FILTERS, default: str = "allow"):
        self.default = default
        self.by_host: dict[str, list[PathRule]] = {}
        for rule in sorted(path_rules, key=lambda r: -len(r.host + r.path)):
            self.by_host.setdefault(rule.host, []).append(rule)
        rules = parse_list(filters)
        shared = Counter(t for r in rules for t in r.tokens)
        self.by_token: dict[str, list[tuple[str, re.Pattern]]] = {}
        self.always: list[tuple[str, re.Pattern]] = []
        for rule in rules:
            rarest = min(rule.tokens, key=lambda t: (shared[t], -len(t), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append((rule.verdict, re.compile(rule.regex())))

    def base(self, host: str, path: str) -> PathRule | None:
        """The longest fitting rule: the host's suffixes fetch their rules."""
        found, at = None, 0
        while host and at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path):
                    if found is None or len(rule.host + rule.path) > len(found.host + found.path):
                        found = rule
                    break
            at = host.find(".", at) + 1 or -1
        return found

    def method(self, url: str | None) -> str:
        low, verdict = (url or "").translate(_LOWER), self.default
        for found in (self.always, *(self.by_token.get(t, ()) for t in set(TOKEN.findall(low)))):
            for kind, pattern in found:
                if kind != verdict or verdict == self.default:
                    if pattern.search(low):
                        if kind == "allow":
                            return kind
                        verdict = kind
        return verdict

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        rule = self.base(host, path)
        return (host, path, rule.host + rule.path, rule.verdict) if rule else (host, path, None, self.method(url))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", path_rules=PATH_RULES, filters: Iterable[str] = FILTERS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; no shuffle.

    A null or unparsable url has empty host and path, no rule, and the default verdict unless a filter fits it.
    Very long urls are judged whole. Repeated rows and ids each give a row, an empty table none; other columns are not
    read, so they may have any name.
    """
    filters = tuple(filters)

    def make():
        index = RuleIndex(path_rules, filters, default)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [index.judge(u) for u in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

        return one

    return map_batches(pages.selectExpr(f"cast(`{id_col}` as bigint) page_id", f"cast(`{url_col}` as string) url"), make, "page_id bigint, host string, path string, rule string, verdict string")


def _fits(verdict: str) -> str:
    """SQL for DuckDB: whether any rule of a verdict fits; all rules are tried, without an index."""
    return "regexp_matches(low, '" + "|".join(f"(?:{f.regex(chr(92) + 'z')})" for f in parse_list(FILTERS) if f.verdict == verdict) + "')"


def oracle() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}')" for r in PATH_RULES)
    by_rule = " ".join(f"when rule = '{r.host}{r.path}' then '{r.verdict}'" for r in PATH_RULES)
    return rf"""
with s as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from pages),
h as (select *, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) path from s),
r as (select *, (select list(host || path order by length(host || path) desc)[1] from (values {rules}) t(host, path)
    where (h.host = t.host or ends_with(h.host, '.' || t.host)) and starts_with(h.path, t.path)) rule from h)
select page_id, host, path, rule, case {by_rule} when {_fits("allow")} then 'allow' when {_fits("block")} then 'block' else 'allow' end verdict from r"""
