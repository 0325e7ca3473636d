"""Queries: address numbers of addresses in a dozen formats, whose fields are known from what they are made of; similarities of true edges."""

from pyspark.sql import functions as F

from erlink.functions import address as A
from erlink.operators import blocking as B
from erlink.operators import features as P
from erlink.plans.fixtures import K, duck, spark_sql
from erlink.plans.queries_match import records
from erlink.plans.registry import query

N_FORMATS = 12
_U, _Z, _PIN = f"(1 + {K} % 60)", f"(60000 + ({K} * 13) % 3000)", f"(400000 + ({K} * 17) % 90000)"


def _s(x: str) -> str:
    return f"cast({x} as «S»)"


def address_sql(h: str, f: str) -> str:
    """An address of house number h in format f, and its country."""
    h, u, z, p = _s(h), _s(_U), _s(_Z), _s(_PIN)
    return f"""(case {f} when 0 then concat('00', {h}, ' Elm Street, Unit ', {u}, ', Springfield, IL ', {z}) when 1 then concat('#', {h}, ' HAWK TRL, TOWN, TX') when 2 then concat({h}, '-', {u}, ' Long Street, Albany, New York ', {z})
 when 3 then concat({h}, ' 1/2 Vine Street, # ', {u}, ', Dayton, OH') when 4 then concat({h}, ' County Road ', {u}, ', WACO') when 5 then concat('Flat No ', {u}, ', Plot No ', {h}, '/', {u}, ' Lake Nagar, Pune - ', substr({p}, 1, 3), ' ', substr({p}, 4, 3))
 when 6 then concat('H.No. ', {h}, '-B, Sector ', {u}, ', Delhi, ', {p}) when 7 then concat('Survey No ', {h}, ', Old Village, Ward No ', {u}) when 8 then concat('C-', {h}, ', 2Nd Floor, Park') when 9 then concat('3Rd Main, Sector ', {h})
 when 10 then concat({h}, ' Rue Haute, 75001 Paris') else '<NULL>' end)"""


def country_sql(f: str) -> str:
    return f"(case when {f} < 5 then 'US' when {f} < 10 then 'India' else 'France' end)"


def fields_sql(h: str, f: str) -> str:
    """DuckDB: the seven fields that such an address has."""
    h, u, z, p = (duck(_s(x)) for x in (h, _U, _Z, _PIN))
    house = f"(case {f} when 2 then {h} || '-' || {u} when 3 then {h} || ' 1/2' when 5 then {h} || '/' || {u} when 6 then {h} || '-B' when 8 then 'C-' || {h} when 9 then '' when 11 then '' else {h} end)"
    atoms = f"(case {f} when 2 then [{h}, {u}] when 3 then [{h}, '1', '2'] when 5 then [{h}, {u}] when 9 then [] when 11 then [] else [{h}] end)"
    tokens = f"(case {f} when 0 then [{h}, {u}] when 1 then [{h}] when 3 then [{h}, '1', '2', {u}] when 8 then [{h}] when 9 then [{h}] when 10 then [{h}, '75001'] when 11 then [] else [{h}, {u}] end)"
    ordered = f"list_transform(list_sort(list_transform(list_distinct({tokens}), lambda x: lpad(x, 9, '0'))), lambda x: ltrim(x, '0'))"
    return f"""{house} primary_house_number, coalesce({atoms}[1], '') house_head, array_to_string({atoms}, '|') house_atoms, case when len({atoms}) > 1 then {house} else '' end compound_number,
 case when {f} in (0, 3, 5) then {u} else '' end unit_number, case when {f} in (0, 2) then {z} when {f} in (5, 6) then {p} else '' end postal_strict, array_to_string({ordered}, ' ') number_tokens, {ordered} tk"""


_H1, _F1 = f"(100 + (37 * {K}) % 8999)", f"({K} % {N_FORMATS})"
#: The other side of a pair: every fifth house number is another, the format is one of the other ones.
_H2, _F2 = f"({_H1} + (case when {K} % 5 = 0 then 1 else 0 end))", f"(({K} * 5 + 3) % {N_FORMATS})"
_FIELDS = "primary_house_number, house_head, house_atoms, compound_number, unit_number, postal_strict, number_tokens"


def numbers(c, h: str, f: str):
    raw = c.table("part").selectExpr(f"concat('S1-', p_partkey) entity_id", f"{spark_sql(address_sql(h, f))} business_address", f"{country_sql(f)} country".replace("bigint", "long"))
    return A.numbers_of(raw)


@query("a07_address_formats", f"select concat('S1-', p_partkey) entity_id, {country_sql(duck(_F1))} country, {_FIELDS} from (select p_partkey, {fields_sql(_H1, duck(_F1))} from part)")
def _(c):
    return numbers(c, _H1, spark_sql(_F1))


def _same(x: str) -> str:
    return f"(a.{x} <> '' and b.{x} <> '' and a.{x} = b.{x})::int"


def _differ(x: str) -> str:
    return f"(a.{x} <> '' and b.{x} <> '' and a.{x} <> b.{x})::int"


_FLAGS = {"num_hn_head": "house_head", "num_compound": "compound_number", "num_unit": "unit_number", "num_postal": "postal_strict"}
_FEATURES = ["num_hn_full_equal", *(f"{x}_equal" for x in _FLAGS), *(f"{x}_mismatch" for x in _FLAGS), "num_token_overlap", "num_token_contradiction", "num_token_symdiff", "num_token_jaccard"]


@query("f29_f41_extracted_numbers", f"""with a as (select p_partkey, {fields_sql(_H1, duck(_F1))} from part), b as (select p_partkey, {fields_sql(_H2, duck(_F2))} from part), j as (select a.p_partkey, {_same('primary_house_number')} num_hn_full_equal,
 {", ".join(f"{_same(f)} {x}_equal, {_differ(f)} {x}_mismatch" for x, f in _FLAGS.items())}, len(list_intersect(a.tk, b.tk)) k, len(a.tk) x, len(b.tk) y from a join b using (p_partkey))
 select concat('S1-', p_partkey) s1_id, num_hn_full_equal, {", ".join(f"{x}_equal, {x}_mismatch" for x in _FLAGS)}, least(k, 5)::int num_token_overlap, (k < x and k < y)::int num_token_contradiction, least(x + y - 2 * k, 5)::int num_token_symdiff, round(case when x = 0 or y = 0 then 0.0 else k / (x + y - k) end, 6)::double num_token_jaccard from j""")
def _(c):
    a, b = numbers(c, _H1, spark_sql(_F1)), numbers(c, _H2, spark_sql(_F2))
    pairs = a.select(F.col("entity_id").alias("s1_id"), F.col("entity_id").alias("cand_id"))
    rows = P.number_features(B.hydrate(pairs, a, b, P.NUMBER_COLUMNS))
    return rows.select("s1_id", *(F.round(x, 6).alias(x) if x == "num_token_jaccard" else F.col(x) for x in _FEATURES))


#: DuckDB: 1 - insertion-deletion distance / length of every (a, b), by the same bits as a machine word would hold: a bit per character of a.
_RATIO = """masks as (select *, map_from_entries(list_transform(list_distinct(string_split(a, '')), lambda c: (c, list_sum(list_transform(range(0, length(a)), lambda i: case when substr(a, (i + 1)::bigint, 1) = c then 1::hugeint << i::int else 0::hugeint end))))) m from long_),
steps as (select *, list_transform(string_split(b, ''), lambda c: coalesce(m[c], 0)::hugeint) hits, (1::hugeint << length(a)::int) - 1 whole from masks),
ratio as (select s1_id, cand_id, kind, case when length(a) + length(b) = 0 then 1.0 when a = '' or b = '' then 0.0 else 2.0 * (length(a) - bit_count(list_reduce(list_prepend(whole, hits), lambda acc, h: ((acc + (acc & h)) | (acc - (acc & h))) & whole))) / (length(a) + length(b)) end r from steps)"""
_TOKENS = "list_sort(list_filter(string_split({0}, ' '), lambda t: t <> ''))"


@query("f06_f09_f20_f22_edges", f"""with h as (select t.s1_id, t.cand_id, s.name_norm n1, p.name_norm n2, s.address_norm a1, p.address_norm a2, {_TOKENS.format('s.name_norm')} w1, {_TOKENS.format('p.name_norm')} w2 from truth t join s1 s on s.entity_id = t.s1_id join pool p on p.entity_id = t.cand_id),
g as (select *, array_to_string(list_sort(list_distinct(list_filter(w1, lambda t: list_contains(w2, t)))), ' ') b, array_to_string(list_sort(list_distinct(list_filter(w1, lambda t: not list_contains(w2, t)))), ' ') l, array_to_string(list_sort(list_distinct(list_filter(w2, lambda t: not list_contains(w1, t)))), ' ') r from h),
o as (select *, case when b = '' then l else b || ' ' || l end o1, case when b = '' then r else b || ' ' || r end o2 from g),
long_ as (select s1_id, cand_id, 'plain' kind, n1 a, n2 b from o union all select s1_id, cand_id, 'sort', array_to_string(w1, ' '), array_to_string(w2, ' ') from o union all select s1_id, cand_id, 'set', o1, o2 from o union all select s1_id, cand_id, 'address', a1, a2 from o), {_RATIO},
p as (select s1_id, cand_id, max(r) filter (kind = 'plain') plain, max(r) filter (kind = 'sort') sorted_, max(r) filter (kind = 'set') set_, max(r) filter (kind = 'address') address from ratio group by all)
select s1_id, cand_id, round(plain, 6) name_fuzz_ratio, round(sorted_, 6) name_fuzz_token_sort_ratio, round(case when len(w1) = 0 or len(w2) = 0 then 0.0 when b <> '' and (l = '' or r = '') then 1.0 when b = '' then set_ else greatest(set_, 2.0 * length(b) / (length(b) + length(o1)), 2.0 * length(b) / (length(b) + length(o2))) end, 6) name_fuzz_token_set_ratio,
 round(plain, 6) name_translit_fuzz_ratio, round(address, 6) address_fuzz_ratio, round(plain * address, 6) name_addr_product from p join o using (s1_id, cand_id)""", "er")
def _(c):
    rows = P.similarity_features(B.hydrate(c.truth, records(c, "s1"), records(c, "pool"), P.RECORD_COLUMNS))
    names = ("name_fuzz_ratio", "name_fuzz_token_sort_ratio", "name_fuzz_token_set_ratio", "name_translit_fuzz_ratio", "address_fuzz_ratio", "name_addr_product")
    return rows.select("s1_id", "cand_id", *(F.round(x, 6).alias(x) for x in names))
