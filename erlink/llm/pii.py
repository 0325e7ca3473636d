"""Personal data by weak supervision; DataFrame operations only.

Generators propose spans: the base patterns of the task, and wider ones (spelled-out and spaced addresses, national
numbers, numbers that a base match swallowed, identity and account numbers, credentials). Labelers vote on each proposal:
its format (regex), lists of top-level domains, issuers, calling codes, countries and prefixes (gazetteer), arithmetic
(checksum), cue words before it (context) and its neighbours (edges). Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, without any label; its posteriors then train the final classifier, a
naive Bayes table over votes and shape. Base spans that hold stay; of the other proposals the classifier alone decides,
and those are added that overlap no span of their kind.

Proposals are array columns beside their document: nothing is shuffled but the counts of patterns, of which there are
at most KINDS x 3**5 x shapes. Offsets are code points, ends exclusive. Sums and maxima along an array are taken by
doubling (n log n), so a text with very many matches takes no square of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erlink.llm.common import materialize, neutral

#: The kinds of the task, with base patterns, and those that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")

#: Base patterns of the task in possessive form: the same matches, without deep or repeated backtracking. \G or a
#: look-behind keeps a search from starting anew inside a run that has just failed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can match at all; with_digit: it has a digit.
TRIGGER = {"email": "instr(txt, '@') > 0", "ip": r"with_digit and txt rlike '[0-9]\\.[0-9]'", "card": "with_digit and txt rlike '[0-9][0-9 -]{12}'", "phone": "instr(txt, '+') > 0"}
#: Wider generators: kind, pattern, trigger. Every match has 5 characters at least.
WIDE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++", "instr(txt, '(at') > 0 or instr(txt, '[at') > 0"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++", "instr(txt, ' dot ') > 0 or instr(txt, ' DOT ') > 0"),
    ("ip", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "with_digit and txt rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20\.\x20?[0-9]{1,3}){3}(?![0-9.])", r"with_digit and txt rlike '[0-9] \\. ?[0-9]'"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])", "with_digit and txt rlike '[0-9]{4}[0-9 -]{12}'"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])", r"with_digit and txt rlike '[0-9]{4}\\.[0-9]{4}\\.'"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", "instr(txt, '+') > 0"),
    ("phone", r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "instr(txt, '(') > 0"),
    ("phone", r"(?<![0-9+(./-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9./-])", r"with_digit and txt rlike '[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}'"),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9])", "with_digit and txt rlike '00[1-9][0-9]{0,2}[ ./-][0-9]'"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "with_digit and txt rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "with_digit and txt rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'"),
    ("secret", r"(?<![A-Za-z0-9_])(?:(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp])[_-][A-Za-z0-9_-]{16,}+|(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])", "with_digit and txt rlike '[A-Za-z0-9_-]{19}'"),
    ("secret", r"(?i:password|passwd|passphrase|pwd)[\"']?\x20?[:=]\x20?[\"']?[^\s\"',;<>]{6,}+", "txt rlike '[pP][aA][sS][sS]|[pP][wW][dD]'"),
)

#: Own lists for the gazetteer and context labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu|us|ch|at|nl"
CALLING_CODES = "1|7|20|27|3[0-49]|36|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6"
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|NL|NO|PL|PT|RO|SE|SI|SK"
CREDENTIALS = "sk|pk|rk|ghp|gho|ghs|glpat|xox|AKIA|ASIA|eyJ|AIza"
CUES = {
    "email": "e-?mail|contact|write to|mailto", "ip": r"\\bip\\b|address|host|server|addr", "card": "card|visa|mastercard|payment|credit", "phone": "phone|tel|call|mobile|fax|contact",
    "id": "ssn|social security|iban|account|passport|tax id|national id", "secret": "token|secret|password|passwd|passphrase|pwd|api.?key|auth|bearer|credential",
}
ANTI_CUES = r"version|isbn|hash|token|password|serial|order no|ticket|\\bid\\b ?[:=]"
SECRET_ANTI_CUES = "sha-?[0-9]|md5|checksum|commit|digest|etag|version|isbn"

VOTES = ("regex", "gazetteer", "checksum", "context", "edges")
#: Before the first step votes count alike, but for arithmetic: where nothing else tells proposals apart, it decides.
FIRST_WEIGHT = {"checksum": 3}
SHAPES = 24
EM_STEPS = 40
SURE = 0.9
#: Characters before a span in which the context labeler looks. So many matches before it reach further back, as each has 5 at least.
REACH, BEFORE = 48, 10

#: Code points of a piece when a text is cut for masking.
CUT = 4096

_SPAN = "array<struct<kind:int,s:int,e:int,v:string,pre:string,post:string,base:boolean>>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _along(array: str, both: str) -> str:
    """SQL: for every place of an array, the elements up to it put together by both(v, w), by doubling the reach."""
    step = f"transform(acc, (v, i) -> {_let('get(acc, i - shiftleft(1, j))', 'w', f'if(w is null, v, {both})')})"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({array}), 2))) as int)), {array}, (acc, j) -> {step})"


def _located(kind: int, base: bool, i: int) -> str:
    """Spans of generator i from its matches m{i} and the pieces p{i} between them."""
    lengths = "transform(g.m, (v, k) -> length(g.p[k]) + length(v))"
    tails = f"transform(g.m, (v, k) -> right(concat(right(g.p[k], {REACH}), v), {REACH}))"
    pre = f"lower(right(concat(array_join(slice(g.t, greatest(k - {BEFORE}, 0) + 1, least(k, {BEFORE})), ''), right(g.p[k], {REACH})), {REACH}))"
    out = f"transform(g.m, (v, k) -> named_struct('kind', {kind}, 's', g.e[k] - length(v), 'e', g.e[k], 'v', v, 'pre', {pre}, 'post', left(g.p[k + 1], 1), 'base', {str(base).lower()}))"
    ends = _let(f"named_struct('m', g.m, 'p', g.p, 't', {tails}, 'e', {_let(lengths, 'l', _along('l', 'v + w'))})", "g", out)
    return _let(f"named_struct('m', m{i}, 'p', p{i})", "g", ends)


def _valid(x: str) -> str:
    """SQL: the check of a proposal; for the base kinds, that of the task."""
    digits = f"regexp_replace({x}.v, '[^0-9]', '')"
    digit = f"cast(substring({digits}, length({digits}) - i + 1, 1) as int)"
    luhn = f"(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + (case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0)"
    octets = rf"forall(split(replace({x}.v, ' ', ''), '\\.'), o -> length(ltrim('0', o)) <= 3 and cast(concat('0', left(ltrim('0', o), 3)) as int) <= 255)"
    plain = f"replace({x}.v, ' ', '')"
    iban = f"(aggregate(split(concat(substring({plain}, 5), left({plain}, 4)), ''), 0, (a, c) -> (case when c = '' then a when c between '0' and '9' then a * 10 + cast(c as int) else a * 100 + ascii(c) - 55 end) % 97) = 1)"
    return f"""(case {x}.kind when 1 then true when 2 then (case when instr({x}.v, ':') > 0 then true else {octets} end)
        when 3 then (case when length({digits}) between 14 and 19 then {luhn} else false end) when 4 then length({digits}) between 10 and 15
        when 5 then (case when {x}.v rlike '^[A-Z]' then {iban} else not {x}.v rlike '^(000|666|9)|-00-|-0000$' end)
        else size(array_distinct(split(left({x}.v, 64), ''))) >= 8 end)"""


def _votes(x: str) -> str:
    """SQL: the labelers' votes on a proposal, -1, 0 or 1, and its shape, as a struct."""
    strict = rf"""(case {x}.kind when 1 then {x}.v rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$|[\\[(]at[\\])].*[\\[(]dot[\\])]' when 2 then {x}.v rlike '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$|:'
        when 3 then {x}.v rlike '^[0-9]{{4}}([ -]?[0-9]{{4}}){{3}}$' when 4 then {x}.v rlike '^(\\+[0-9]{{1,3}}[ .-]?)?\\(?[0-9]{{2,4}}\\)?([ .-]?[0-9]{{3,4}}){{2}}$'
        when 5 then true else {x}.v rlike '^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$|^({CREDENTIALS})|[:=]|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9])' end)"""
    gazetteer = rf"""(case {x}.kind when 1 then lower({x}.v) rlike '[. )\\]]({DOMAINS})$' when 2 then not {x}.v rlike '^(0|127|22[4-9]|2[3-5][0-9])\\.'
        when 3 then {x}.v rlike '^({ISSUERS})' when 4 then (case when {x}.v like '+%' then {x}.v rlike '^\\+({CALLING_CODES})' end)
        when 5 then (case when {x}.v rlike '^[A-Z]' then {x}.v rlike '^({IBAN_COUNTRIES})' end) else (case when {x}.v rlike '^({CREDENTIALS})' then true end) end)"""
    cue = " ".join(f"when {k + 1} then concat({x}.pre, if({k + 1} = 6, lower(left({x}.v, 16)), '')) rlike '{CUES[name]}'" for k, name in enumerate(KINDS))
    sign = lambda sql: f"(case when ({sql}) then 1 when not ({sql}) then -1 else 0 end)"  # noqa: E731  # null: no vote
    edges = f"not (right({x}.pre, 1) rlike '[a-z0-9]' or {x}.post rlike '[A-Za-z0-9]')"
    return f"""named_struct('regex', {sign(strict)}, 'gazetteer', {sign(gazetteer)}, 'checksum', if({_valid(x)}, 1, -1),
        'context', (case when {x}.pre rlike if({x}.kind = 6, '{SECRET_ANTI_CUES}', '{ANTI_CUES}') then -1 when (case {x}.kind {cue} end) then 1 else 0 end), 'edges', if({edges}, 1, -1),
        'shape', cast(least(length({x}.v) div 6, 5) * 4 + least(length(regexp_replace({x}.v, '[^ .-]', '')), 3) as int))"""


def with_proposals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a column _proposals: arrays of kind, s, e, base, valid and votes. Null texts count as empty."""
    rows = docs.withColumn("_txt", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = rows.withColumn("_digit", F.col("_txt").rlike("[0-9]"))
    generators = [(k + 1, BASE[name], TRIGGER[name], True) for k, name in enumerate(BASE_KINDS)] + [(KINDS.index(name) + 1, pattern, trigger, False) for name, pattern, trigger in WIDE]
    found = {}
    for i, (_, pattern, trigger, _b) in enumerate(generators):
        when = f"case when {trigger.replace('txt', '_txt').replace('with_digit', '_digit')} then"
        found[f"m{i}"] = F.expr(f"{when} regexp_extract_all(_txt, {_sql(pattern)}, 0) else cast(array() as array<string>) end")
    rows = rows.withColumns(found)
    pieces = {f"p{i}": F.expr(f"case when size(m{i}) > 0 then split(_txt, {_sql(pattern)}, -1) else array('') end") for i, (_, pattern, _t, _b) in enumerate(generators)}
    rows = rows.withColumns(pieces)
    located = [f"if(size(m{i}) = 0, cast(array() as {_SPAN}), {_located(kind, base, i)})" for i, (kind, _, _, base) in enumerate(generators)]
    rows = rows.withColumn("_found", F.expr(f"concat({', '.join(located)})")).drop(*found, *pieces, "_txt", "_digit")
    return rows.withColumn("_proposals", F.expr(f"transform(_found, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'base', x.base, 'valid', {_valid('x')}, 'votes', {_votes('x')}))")).drop("_found")


@dataclass(frozen=True)
class SpanClassifier:
    """Naive Bayes: per kind a prior, and log-odds for the values of each feature; reliabilities are the labelers'."""

    prior: dict[int, float]
    odds: dict[tuple[int, str, int], float]
    reliability: dict[tuple[int, str], tuple[float, float]]

    def score(self, x: str) -> str:
        """SQL: the log-odds that proposal x is personal data; kinds without proposals to learn from are never sure."""
        table = lambda values: "array(" + ", ".join(f"{v!r}D" for v in values) + ")"
        kinds = range(1, len(KINDS) + 1)
        parts = [f"element_at({table(self.prior.get(k, -99.0) for k in kinds)}, {x}.kind)"]
        for f in VOTES:
            parts.append(f"element_at({table(self.odds.get((k, f, v), 0.0) for k in kinds for v in (-1, 0, 1))}, ({x}.kind - 1) * 3 + {x}.votes.{f} + 2)")
        parts.append(f"element_at({table(self.odds.get((k, 'shape', v), 0.0) for k in kinds for v in range(SHAPES))}, ({x}.kind - 1) * {SHAPES} + {x}.votes.shape + 1)")
        return " + ".join(parts)

    def log_odds(self, kind: int, votes: dict[str, int]) -> float:
        """The same for one proposal, in Python."""
        return self.prior.get(kind, -99.0) + sum(self.odds.get((kind, f, votes[f]), 0.0) for f in (*VOTES, "shape"))


def fit(proposed: DataFrame) -> SpanClassifier:
    """EM over the counts of vote patterns of all proposals, then the classifier from its posteriors."""
    x = F.col("x")
    counted = proposed.select(F.explode("_proposals").alias("x")).groupBy(x["kind"].alias("kind"), *(x["votes"][f].alias(f) for f in (*VOTES, "shape"))).agg(F.count(F.lit(1)).alias("n"))
    patterns = [r.asDict() for r in counted.collect()]  # bounded: kinds x 3**5 x shapes
    patterns.sort(key=lambda r: tuple(r[c] for c in ("kind", *VOTES, "shape")))
    prior, odds, reliability = {}, {}, {}
    for kind in sorted({r["kind"] for r in patterns}):
        rows = [r for r in patterns if r["kind"] == kind]
        post = [1 / (1 + math.exp(-sum(r[v] * FIRST_WEIGHT.get(v, 1) for v in VOTES))) for r in rows]
        for _ in range(EM_STEPS):
            total = sum(r["n"] for r in rows)
            yes = sum(p * r["n"] for p, r in zip(post, rows, strict=True))
            share = min(0.99, max(0.01, (yes + 1) / (total + 2)))
            rates = {}
            for v in VOTES:  # how often each vote is cast, given the truth
                for vote in (-1, 0, 1):
                    a = sum(p * r["n"] for p, r in zip(post, rows, strict=True) if r[v] == vote)
                    b = sum((1 - p) * r["n"] for p, r in zip(post, rows, strict=True) if r[v] == vote)
                    # Smoothing says, weakly, that labelers are better than chance.
                    rates[v, vote] = ((a + 1 + (vote == 1)) / (yes + 4), (b + 1 + (vote == -1)) / (total - yes + 4))
            post = []
            for r in rows:
                z = math.log(share / (1 - share)) + sum(math.log(rates[v, r[v]][0] / rates[v, r[v]][1]) for v in VOTES)
                post.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        for v in VOTES:
            reliability[kind, v] = (rates[v, 1][0], rates[v, -1][1])
        yes = sum(p * r["n"] for p, r in zip(post, rows, strict=True))
        no = sum((1 - p) * r["n"] for p, r in zip(post, rows, strict=True))
        prior[kind] = math.log((yes + 1) / (no + 1))
        for f in (*VOTES, "shape"):
            for value in sorted({r[f] for r in rows}):
                a = sum(p * r["n"] for p, r in zip(post, rows, strict=True) if r[f] == value)
                b = sum((1 - p) * r["n"] for p, r in zip(post, rows, strict=True) if r[f] == value)
                odds[kind, f, value] = math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2))
    return SpanClassifier(prior, odds, reliability)


def _clear(marked: str) -> str:
    """SQL: of an array of (lo, added, hi) in order, the added ones that overlap none that is not added, and then no earlier added one.

    A running maximum of the ends before a span and a running minimum of the starts after it tell.
    """
    far = "9223372036854775807L"
    ends = _let("transform(a, x -> if(x.added = 0, x.hi, 0L))", "l", _along("l", "greatest(v, w)"))
    starts = f"reverse({_let(f'transform(reverse(a), x -> if(x.added = 0, x.lo, {far}))', 'l', _along('l', 'least(v, w)'))})"
    free = f"filter(h.a, (x, k) -> x.added = 1 and coalesce(get(h.e, k - 1), 0L) <= x.lo and coalesce(get(h.s, k + 1), {far}) >= x.hi)"
    free = _let(f"named_struct('a', a, 'e', {ends}, 's', {starts})", "h", free)
    before = _let("transform(b, x -> x.hi)", "l", _along("l", "greatest(v, w)"))
    first = _let(f"named_struct('b', b, 'e', {before})", "h", "filter(h.b, (x, k) -> coalesce(get(h.e, k - 1), 0L) <= x.lo)")
    return _let(f"array_sort({marked})", "a", _let(free, "b", first))


def with_spans(proposed: DataFrame, model: SpanClassifier) -> DataFrame:
    """Adds _base and _spans, sorted arrays of (s, kind, e): the base spans that hold, and these with the added ones."""
    limit, kind_at = math.log(SURE / (1 - SURE)), 1 << 40  # spans of different kinds lie apart
    pick = "named_struct('s', x.s, 'kind', x.kind, 'e', x.e)"
    rows = proposed.withColumn("_base", F.expr(f"array_sort(transform(filter(_proposals, x -> x.base and x.valid), x -> {pick}))"))
    rows = rows.withColumn("_sure", F.expr(f"filter(_proposals, x -> not x.base and ({model.score('x')}) >= {limit!r}D)"))
    place = lambda added: f"named_struct('lo', x.kind * {kind_at}L + x.s, 'added', {added}, 'hi', x.kind * {kind_at}L + x.e)"
    marked = f"concat(transform(_base, x -> {place(0)}), transform(_sure, x -> {place(1)}))"
    more = f"transform({_clear(marked)}, x -> named_struct('s', cast(x.lo % {kind_at}L as int), 'kind', cast(x.lo div {kind_at}L as int), 'e', cast(x.hi % {kind_at}L as int)))"
    return rows.withColumn("_spans", F.expr(f"if(size(_sure) = 0, _base, array_sort(concat(_base, {more})))")).drop("_sure")


def listing(spans: str) -> Column:
    names = "element_at(array('" + "', '".join(KINDS) + "'), x.kind)"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}, ':', x.s, ':', x.e)), ',')")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (all) for every row of docs.

    Null texts count as empty and give zeros and an empty list, whose digest is that of no bytes. Spans of two kinds may
    overlap; both are listed. Very long texts are read whole, in time n log n of their matches. Repeated rows and ids
    each give a row; an empty table gives none; other columns are not read, so they may have any name.
    """
    proposed = with_proposals(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("doc_id", "_proposals")
    proposed = materialize(proposed, "pii-proposals")
    rows = with_spans(proposed, fit(proposed))
    counts = [F.expr(f"cast(size(filter(_base, x -> x.kind = {k + 1})) as bigint) n_{name}") for k, name in enumerate(BASE_KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listing("_base"), 256).alias("base_sha256"), listing("_spans").alias("spans"), F.size("_spans").cast("bigint").alias("n_spans"))


def _masked(text: str) -> str:
    """SQL: text with its _spans replaced. Spans that overlap are one, from its start to the greatest of the ends.

    The text is cut once into pieces of CUT code points, so that each part is taken from the pieces it lies in.
    """
    names = "element_at(array('" + "', '".join(f"<{k.upper()}>" for k in KINDS) + "'), x.kind)"
    ends = _let("transform(_spans, x -> x.e)", "l", _along("l", "greatest(v, w)"))
    opens = "filter(transform(g.a, (x, k) -> named_struct('s', x.s, 'kind', x.kind, 'k', k)), x -> x.k = 0 or x.s >= g.e[x.k - 1])"
    part = lambda lo, hi: f"substring(array_join(slice(g.c, {lo} div {CUT} + 1, greatest({hi} - 1, {lo}) div {CUT} - {lo} div {CUT} + 1), ''), {lo} % {CUT} + 1, {hi} - {lo})"
    # The text between two groups begins where the spans before the later one end.
    before = _let("if(x.k = 0, 0, g.e[x.k - 1])", "f", part("f", "x.s"))
    parts = f"transform(g.o, x -> concat({before}, {names}))"
    rest = _let("element_at(g.e, -1)", "f", part("f", "g.n"))
    body = f"concat(array_join({parts}, ''), if(element_at(g.e, -1) < g.n, {rest}, ''))"
    pieces = f"regexp_extract_all({text}, '(?s).{{1,{CUT}}}', 0)"
    return _let(f"named_struct('a', _spans, 'e', {ends})", "g", _let(f"named_struct('e', g.e, 'o', {opens}, 'c', {pieces}, 'n', length({text}))", "g", body))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind, as <EMAIL>; overlapping spans become one, of the first's kind.

    Null texts stay null, texts without a span as they are; other columns keep their values, whatever their names. An
    empty table stays empty; repeated rows are masked alike; very long texts are masked whole. The generators run once:
    their proposals are written beside the rows, and the classifier is fitted on that column alone.
    """
    plain, given = neutral(docs)
    text_col = given[text_col]
    proposed = materialize(with_proposals(plain, text_col), "pii-proposals")
    rows = with_spans(proposed, fit(proposed.select("_proposals")))
    text = F.col(f"`{text_col}`")
    return rows.withColumn(text_col, F.when(F.size("_spans") > 0, F.expr(_masked(f"cast(`{text_col}` as string)"))).otherwise(text)).select(*plain.columns).toDF(*docs.columns)
