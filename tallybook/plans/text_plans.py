"""Text and number expressions, passages and vocabularies over documents, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook import fixed_values as V
from tallybook.functions import dates as D, money as M, numbers as N, text as X
from tallybook.operators import passages as P
from tallybook.plans import bindings as B
from tallybook.plans.registry import query, table

SPLIT = "string_split(text, chr(10))"
WORDS_OF = r"list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda w: w <> '')"


@query("number_parse", """with a as (select o_orderkey, cast(floor(o_totalprice * 100 + 0.5) as bigint) as c, o_orderstatus from orders)
select o_orderkey, form, v, is_number from (select o_orderkey,
  unnest(['(' || format('{:,}', c) || ')', '$' || format('{:,}', c), format('{:,}', c) || '*', '-', '', printf('%.2f', c / 100.0), o_orderstatus, '-' || c]) as form,
  unnest([-c::double, c, c, null, null, c / 100.0, null, -c]) as v, unnest([true, true, true, false, false, true, false, true]) as is_number from a)""")
def number_parse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", B.cents("o_totalprice").alias("c"))
    comma = F.format_number("c", 0)
    forms = F.array(F.concat(F.lit("("), comma, F.lit(")")), F.concat(F.lit("$"), comma), F.concat(comma, F.lit("*")), F.lit("-"),
                    F.lit(""), F.format_string("%.2f", F.col("c") / 100), F.col("o_orderstatus"),
                    F.concat(F.lit("-"), F.col("c").cast("string")))
    rows = o.select("o_orderkey", F.explode(forms).alias("form"))
    return rows.select("o_orderkey", "form", N.parse_decimal(F.col("form")).cast("double").alias("v"),
                       N.is_number_token(F.col("form")).alias("is_number"))


@query("amount_words", """with p as (select p_partkey, p_size, case p_type when 'PROMO' then 'billion' when 'ECONOMY' then '' else 'million' end as unit, p_size * 25 as n from part)
select p_partkey, case when unit <> '' and n >= 1000 then null when unit = 'billion' then n * 1000000000::bigint when unit = 'million' then n * 1000000::bigint else n::bigint end as amount from p""")
def amount_words(spark, sf):
    p = table(spark, sf, "part")
    unit = F.when(F.col("p_type") == "PROMO", "billion").when(F.col("p_type") == "ECONOMY", "").otherwise("million")
    text = F.concat(F.lit("Rebuild ($"), F.format_number(F.col("p_size") * 25, 0), F.lit(" "), unit, F.lit(")"))
    return p.select("p_partkey", N.amount_in_words(F.regexp_extract(text, V.PAREN_AMOUNT, 1),
                                                   F.regexp_extract(text, V.PAREN_AMOUNT, 2)).alias("amount"))


REASONS = ["Position Title Reclassification", "Moved to ", "Reflect acceptance of FY25 COPS Hiring Grant for ", "Convert contract to city position in ",
           "Delete position paid through ARPA funds in ", "Position eliminated in "]
CATEGORIES = ["reclassification", "transfer", "grant_change", "contract_to_city", "arpa_sunset", "other"]
TYPES = ["STANDARD", "MEDIUM", "SMALL", "LARGE", "PROMO", "ECONOMY"]


@query("reason_category", "select p_partkey, case p_type " + " ".join(f"when '{t}' then '{c}'" for t, c in zip(TYPES, CATEGORIES)) + " end as category from part")
def reason_category(spark, sf):
    p = table(spark, sf, "part")
    lead = F.create_map(*[F.lit(x) for pair in zip(TYPES, REASONS) for x in pair])[F.col("p_type")]
    return p.select("p_partkey", X.reason_category(F.concat(lead, "p_brand")).alias("category"))


@query("reason_counts", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select category, count(*) as n from (select case when coalesce(line, '') = '' then 'other' """ + " ".join(
    f"when regexp_matches(lower(line), '{p}') then '{c}'" for c, p in V.REASON_RULES) + " else 'other' end as category from l) group by category")
def reason_counts(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(X.reason_category(F.col("line")).alias("category")).agg(F.count("*").alias("n"))


@query("money_text", """with a as (select o_orderkey, cast(floor(o_totalprice * 100 + 0.5) as bigint) - 20000000 as d from orders)
select o_orderkey, case when d > 0 then '+' when d < 0 then '−' else '' end || '$' || case when abs(d) >= 1000000 then ((abs(d) + 50000) // 1000000) || '.' || ((abs(d) + 50000) // 100000 % 10) || ' million' else format('{:,}', abs(d)) end as signed_big,
  case when d < 0 then '−' when d > 0 then '+' else '' end || case when abs(d) / 1e6 < 0.1 and d <> 0 then '0.' || lpad(((abs(d) + 5000) // 10000)::varchar, 2, '0') else format('{:,}', (abs(d) + 50000) // 1000000) || '.' || ((abs(d) + 50000) // 100000 % 10) end as signed_millions,
  case when d > 0 then '+' when d < 0 then '−' else '' end || '$' || format('{:,}', abs(d) // 100) || '.' || lpad((abs(d) % 100)::varchar, 2, '0') as signed_cents from a""")
def money_text(spark, sf):
    """Amounts around zero; an exact half of the last printed digit goes away from zero."""
    d = F.col("d")
    o = table(spark, sf, "orders").select("o_orderkey", (B.cents("o_totalprice") - 20000000).alias("d"))
    return o.select("o_orderkey", M.signed_big(d).alias("signed_big"), M.signed_millions(d).alias("signed_millions"),
                    M.signed_cents(d).alias("signed_cents"))


@query("calculate", """with o as (select o_orderkey, floor(o_totalprice) as a, o_custkey::double as b, o_orderkey % 5 as op from orders)
select o_orderkey, (['sum', 'difference', 'percent_change', 'share', 'per'])[op + 1] as op, case op when 0 then round(a + b, 2) when 1 then round(b - a, 2) when 2 then round((b - a) / a * 100, 4)
  when 3 then case when b <> 0 then round(a / b * 100, 4) end else case when b <> 0 then round(a / b, 4) end end as result from o""")
def calculate(spark, sf):
    o = table(spark, sf, "orders")
    op = F.get(F.array(*[F.lit(x) for x in ("sum", "difference", "percent_change", "share", "per")]), (F.col("o_orderkey") % 5).cast("int"))
    rows = o.select("o_orderkey", op.alias("op"), F.floor("o_totalprice").cast("double").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return rows.select("o_orderkey", "op", N.calculate(F.col("op"), F.col("a"), F.col("b")).alias("result"))


@query("mark_terms", """select o_orderkey, 'Paid <mark>' || format('{:,}', cast(floor(o_totalprice * 100 + 0.5) as bigint)) || '</mark> &lt;not 1' || format('{:,}', cast(floor(o_totalprice * 100 + 0.5) as bigint)) || ' or '
  || format('{:,}', cast(floor(o_totalprice * 100 + 0.5) as bigint)) || '0&gt; &amp; rate <mark>7.29</mark>, 7.291' as html from orders""")
def mark_terms(spark, sf):
    o = table(spark, sf, "orders")
    t = F.format_number(B.cents("o_totalprice"), 0)
    text = F.concat(F.lit("Paid "), t, F.lit(" <not 1"), t, F.lit(" or "), t, F.lit("0> & rate 7.29, 7.291"))
    return o.select("o_orderkey", X.mark_terms(text, F.array(t, F.lit("7.29"), F.lit(""))).alias("html"))


@query("excerpts", r"""select doc_id, case when length(text) <= 220 then text else regexp_replace(substring(text, 1, 220), '\s\S*$', '…') end as excerpt from documents""")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query("slugs", r"""select distinct source, lang, trim(regexp_replace(lower(source || ' — ' || lang || '!'), '[^a-z0-9]+', '_', 'g'), '_') as slug from documents""")
def slugs(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang").distinct()
    return d.select("source", "lang", X.slug(F.concat("source", F.lit(" — "), "lang", F.lit("!"))).alias("slug"))


@query("figures_in_text", r"""with f as (select doc_id, unnest(regexp_extract_all(text, '\$?\d[\d,]*(?:\.\d+)?(?:\s(?:million|billion))?%?')) as figure from documents)
select doc_id, figure, count(*) as n from f group by all""")
def figures_in_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.passage_numbers(F.col("text"))).alias("figure"))
    return d.groupBy("doc_id", "figure").agg(F.count("*").alias("n"))


@query("context_short_form", """select doc_id, source as context, 'City — ' || source || ' — p.' || doc_id as header, sha256('m|' || source || '|' || text) as hash from documents""")
def context_short_form(spark, sf):
    d = table(spark, sf, "documents")
    header = X.context_header(F.lit("City"), F.col("source"), F.concat(F.lit("p."), F.col("doc_id").cast("string")))
    return d.select("doc_id", X.short_context(header).alias("context"), header.alias("header"),
                    X.fingerprint(F.lit("m"), F.col("source"), F.col("text")).alias("hash"))


@query("local_days", """select event_id, strftime(timezone('America/Chicago', ts at time zone 'UTC'), '%Y-%m-%d') as day from events""")
def local_days(spark, sf):
    return table(spark, sf, "events").select("event_id", D.local_day(F.col("ts")).cast("string").alias("day"))


PACK = (r"string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?!])\s+([A-Z•])', '\1' || chr(1) || '\2', 'g'), chr(1))")


@query("pack_sentences", rf"""with recursive s as (select doc_id, unnest({PACK}) as t, generate_subscripts({PACK}, 1) as i from documents),
n as (select *, len({WORDS_OF.format('t')}) as n from s),
f as (select doc_id, i, n as cur, 1 as chunk from n where i = 1
  union all select n.doc_id, n.i, case when f.cur + n.n > 320 then n.n else f.cur + n.n end, case when f.cur + n.n > 320 then f.chunk + 1 else f.chunk end
  from f join n on n.doc_id = f.doc_id and n.i = f.i + 1),
c as (select f.doc_id, chunk, string_agg(t, ' ' order by f.i) as text, sum(n.n) as words from f join n on n.doc_id = f.doc_id and n.i = f.i group by all)
select doc_id, text from c where words >= 8""")
def pack_sentences(spark, sf):
    """Whole documents cut into passages of at most 320 words at sentence ends."""
    d = table(spark, sf, "documents")
    sentences = d.select("doc_id", F.posexplode(F.split(P.squeezed(F.col("text")), V.SENTENCE_BREAK_PACK)).alias("i", "t"))
    return P.packed_sentences(sentences, ["doc_id"]).select("doc_id", "text")


LINES = f"""l as (select doc_id, trim(line) as line, pos from (select doc_id, unnest({SPLIT}) as line, generate_subscripts({SPLIT}, 1) - 1 as pos from documents)
  where trim(line) <> '' and trim(line) <> '2027 PROPOSED PLAN AND EXECUTIVE BUDGET SUMMARY' and not regexp_full_match(trim(line), '[0-9]{{1,3}}')),
t as (select *, row_number() over (partition by doc_id order by pos) = 1 as title from l),
s as (select *, not title and len({WORDS_OF.format('line')}) < 6 and line not in ('•', 'o') and right(line, 1) not in ('.', ':') as short from t),
i as (select *, sum(case when short then 0 else 1 end) over (partition by doc_id order by pos) as isl from s),
r as (select *, count_if(short) over (partition by doc_id, isl) as run from i)"""


@query("short_runs", f"with {LINES} select doc_id, cast(pos as integer) as pos, line from r where not short or run < 3")
def short_runs(spark, sf):
    """A document as a page: title kept, footers and page numbers gone, runs of three short lines or more dropped."""
    pages = table(spark, sf, "documents").select("doc_id", F.lit(11).alias("page"), "text")
    return P.drop_label_runs(P.page_lines(pages, ["doc_id"]), ["doc_id", "page"]).select("doc_id", "pos", "line")


@query("tabular_lines", rf"""with l as (select doc_id, unnest({SPLIT}) as line from documents), w as (select doc_id, {WORDS_OF.format('line')} as w from l),
n as (select doc_id, len(w) as n, len(list_filter(w, lambda x: regexp_matches(x, '^[\$\-\(]*[\d][\d,\.]*%?\)?$'))) as k from w)
select doc_id, count(*) as lines, cast(count_if(n > 0 and (k * 2 >= n or (n <= 3 and k >= 1))) as bigint) as tabular from n group by 1""")
def tabular_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.is_tabular(F.col("line"))).alias("tabular"))


CLAIM_STOP = ", ".join("'" + w + "'" for w in V.CLAIM_STOP_WORDS)


def content_sql(c: str) -> str:
    return f"list_distinct([w for w in regexp_extract_all(lower({c}), '[a-z0-9$.%'']+') if w not in ({CLAIM_STOP}) and length(w) > 2])"


BREAK = r"""string_split(regexp_replace({0}, '([.;:])\s+([A-Z0-9$“"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query("statement_passage", rf"""with p as (select doc_id, text, right(text, 300) as statement from documents),
s as (select doc_id, {content_sql('statement')} as wanted, list_filter(list_transform({BREAK.format('text')}, lambda x: trim(x)), lambda x: x <> '') as s from p),
e as (select doc_id, wanted, unnest(s) as t, generate_subscripts(s, 1) as i from s),
c as (select doc_id, t, i, len(list_intersect(wanted, {content_sql('t')})) as score from e),
b as (select *, max(score) over (partition by doc_id) as best from c),
k as (select *, case when score >= best * 0.8 then row_number() over (partition by doc_id, score >= best * 0.8 order by i) end as r from b where best > 0),
w as (select *, r <= 3 as top from k),
n as (select *, coalesce(top, false) or coalesce(lag(top) over o, false) or coalesce(lead(top) over o, false) as keep from w window o as (partition by doc_id order by i)),
j as (select doc_id, string_agg(t, ' ' order by i) as text from n where keep group by doc_id)
select p.doc_id, coalesce(array_to_string(({WORDS_OF.format('j.text')})[1:220], ' '), '') as passage from p left join j using (doc_id)""")
def statement_passage(spark, sf):
    """The last 300 characters of a document as the statement, the whole document as the page it cites."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.statement_passage(F.col("text"), F.expr("right(text, 300)"), F.array().cast("array<string>")).alias("passage"))


@query("verdict_routes", """select o_orderkey::varchar as id, case when o_orderpriority = '5-LOW' then 'definition_ours' when o_orderstatus = 'F' then 'verified'
  when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'passage_insufficient' else 'needs_review' end as verdict, o_orderstatus = 'O' as stale from orders""")
def verdict_routes(spark, sf):
    """Statements about orders: filled ones carry a current verdict, open ones a stale one, and the passage of urgent pending
    orders lacks the amount."""
    o = table(spark, sf, "orders")
    money = F.concat(F.lit("$"), F.format_number(B.cents("o_totalprice"), 0))
    thin = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    items = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("fact").alias("kind"), F.concat(F.lit("It costs "), money).alias("statement"),
                     F.concat(F.lit("The book prints "), F.when(thin, "nothing").otherwise(money)).alias("passage"), F.array(money).alias("anchors"),
                     F.array().cast("array<string>").alias("names"), F.when(F.col("o_orderpriority") == "5-LOW", "ours").alias("definition_source"), "o_orderstatus")
    key = F.substring(F.sha2(F.to_json(F.array("statement", "passage", F.lit("m"))), 256), 1, 16)
    judged = items.where("o_orderstatus <> 'P'").select("id", F.when(F.col("o_orderstatus") == "F", key).otherwise("old").alias("key"), F.lit("verified").alias("verdict"))
    return P.route_verdicts(items, judged, "m").select("id", "verdict", "stale")


@query("dossiers", """select source, doc_id // 64 as section, string_agg(text, chr(10) || chr(10) order by doc_id) as text, count(*) as passages from documents group by all""")
def dossiers(spark, sf):
    """A source's documents as passages; 64 ids make a section, so no dossier grows with the table."""
    d = table(spark, sf, "documents").select("source", F.expr("doc_id div 64").alias("section"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("id"), "text")
    return P.dossier(d, ["source", "section"])


@query("version_difference", """with a as (select doc_id, text from documents where lang <> 'de'), b as (select doc_id, case when lang = 'fr' then text || '.' else text end as text from documents where lang <> 'es')
select coalesce(a.doc_id, b.doc_id) as id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' else 'reworded' end as change
from a full join b using (doc_id) where a.text is distinct from b.text""")
def version_difference(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    new = d.where("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return P.version_difference(d.where("lang <> 'de'"), new)


@query("table_cards", """with s as (select lower(n_name) as dept, n_name, min(extract(year from l_shipdate)) as a, max(extract(year from l_shipdate)) as z
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)
select 'table:' || dept || ':line_items' as id, cast(a as integer) as printed_page, cast(z as integer) as page_end,
  n_name || ' line items, every account in four stages. The numbers are in the structured data, not this text. Summary p.' || case when a = z then a::varchar else a || '–' || z end || '.' as text from s""")
def table_cards(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y")).distinct()
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(
        F.lower("n_name").alias("dept"), B.cite("summary", F.col("y"), F.lit(1)))
    return P.table_cards(rows, "line_items", F.lit("line items, every account in four stages"), B.departments(spark, sf)).select(
        "id", "printed_page", "page_end", "text")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NARRATIVE_KINDS = [(h, f"n:{k}") for h, k in V.NARRATIVE_HEADS] + [(h, f"t:{k}") for h, k in V.TABLE_HEADS]
HEAD_SQL = "case " + " ".join(f"when starts_with(line, {sql_text(h)}) then {{}}".format(sql_text(h)) for h, _ in NARRATIVE_KINDS) + " end"
KIND_SQL = "case head " + " ".join(f"when {sql_text(h)} then {sql_text(k)}" for h, k in NARRATIVE_KINDS) + " end"
SUB_SQL = rf"""lower(list_last(regexp_split_to_array(line, '\s+'))) not in ({', '.join(map(sql_text, V.SUBHEAD_TAIL))}) and len(line) - len(replace(line, ',', '')) < 2
    and regexp_split_to_array(line, '\s+')[1] not in ({', '.join(map(sql_text, V.SUBHEAD_NOT_FIRST))}) and len(regexp_split_to_array(line, '\s+')) between 2 and 9
    and not regexp_matches(line, '[.:,;]$') and regexp_matches(line, {sql_text(V.SUBHEAD)}) and line <> upper(line) and (prev is null or regexp_matches(rtrim(prev), '[.:”)]$'))"""
SENTENCES = PACK.replace("text", "p.text")


@query("narrative_passages", rf"""with recursive
pg as (select source, source as doc, doc_id + 11 as page, concat_ws(chr(10), case when doc_id % 8 = 0 then 'SOURCE OF FUNDS' else upper(source) end,
    case when doc_id % 4 = 1 then 'MISSION: to serve the people of ' || source || ' well and on time.' when doc_id % 4 = 2 then 'SERVICE HIGHLIGHTS' when doc_id % 12 = 3 then 'BUDGET SUMMARY' end,
    case when doc_id % 4 = 2 then '•' || chr(10) || 'Repaired ' || doc_id || ' streets and bridges across all wards of the city this year.' || chr(10) || '•' end,
    case when doc_id % 5 = 0 then 'Street Work and Lighting' end, coalesce(text, '')) as text from documents),
{LINES.replace('doc_id', 'doc, page').replace('from documents', 'from pg')},
ln as (select * from r where not short or run < 3),
ti as (select distinct source, doc, page, case when line = 'SOURCE OF FUNDS' then 'source_of_funds' when page between 17 and 34 then 'summary_tables' else 'department' end as region, line as title from ln join pg using (doc, page) where title),
td as (select *, case region when 'department' then source when 'source_of_funds' then 'gcp-source-of-funds' end as dept from ti),
tr as (select *, sum(turn) over (partition by doc order by page) as rn from (select *, case when lag(region) over w = region and lag(coalesce(dept, '-')) over w = coalesce(dept, '-') then 0 else 1 end as turn from td window w as (partition by doc order by page))),
tl as (select ln.doc, ln.page, pos, line, rn, region, dept, tr.title, {WORDS_OF.format('line')} as w from ln join tr on ln.doc = tr.doc and ln.page = tr.page where not ln.title),
tb as (select *, len(w) > 0 and (len(list_filter(w, lambda x: regexp_matches(x, '^[\$\-\(]*[\d][\d,\.]*%?\)?$'))) * 2 >= len(w)
    or (len(w) <= 3 and len(list_filter(w, lambda x: regexp_matches(x, '^[\$\-\(]*[\d][\d,\.]*%?\)?$'))) >= 1)) as tabular from tl),
hd as (select *, {HEAD_SQL} as head from tb where region <> 'summary_tables' or (len(w) >= 10 and not tabular)),
kd as (select *, coalesce(last_value({KIND_SQL} ignore nulls) over (partition by doc, rn order by page, pos), case when region = 'department' then 'n:other' else 'n:narrative' end) as kind from hd),
pv as (select *, lag(line) over (partition by doc, rn, page order by pos) as prev from kd where head is not null or not (kind like 't:%' or tabular)),
sb as (select *, coalesce(head is null and region = 'department' and kind not like 't:%' and {SUB_SQL}, false) as sub, kind in ('n:service_highlight', 'n:capital_project') as items from pv),
il as (select *, sum(case when head is not null or sub or (items and line = '•') then 1 else 0 end) over w as isl,
    coalesce(last_value(case when head is not null and kind not like 't:%' then head when sub then line end ignore nulls) over w, title) as heading,
    case when head is not null then nullif(trim(substring(line, length(head) + 1)), '') when not sub and not (items and line = '•') and line <> 'o' then line end as rest
  from sb window w as (partition by doc, rn order by page, pos)),
p as (select doc, rn, isl, kind, items, region, dept, coalesce(string_agg(rest, ' ' order by page, pos), '') as text, min(page) as page, arg_min(heading, (page, pos)) as heading from il where kind not like 't:%' group by all),
se as (select doc, rn, isl, whole, unnest(case when whole then [{WORDS_OF.format('p.text')}.array_to_string(' ')] else {SENTENCES} end) as t,
    unnest(range(1, case when whole then 2 else len({SENTENCES}) + 1 end)) as i from (select *, items and len({WORDS_OF.format('text')}) <= 480 as whole from p) p),
sn as (select *, len({WORDS_OF.format('t')}) as n from se),
f as (select doc, rn, isl, i, n as cur, 1 as chunk from sn where i = 1
  union all select sn.doc, sn.rn, sn.isl, sn.i, case when f.cur + sn.n > 320 then sn.n else f.cur + sn.n end, case when f.cur + sn.n > 320 then f.chunk + 1 else f.chunk end
  from f join sn on sn.doc = f.doc and sn.rn = f.rn and sn.isl = f.isl and sn.i = f.i + 1),
c as (select f.doc, f.rn, f.isl, chunk, string_agg(t, ' ' order by f.i) as text, sum(sn.n) as words from f join sn on sn.doc = f.doc and sn.rn = f.rn and sn.isl = f.isl and sn.i = f.i group by all),
o as (select p.*exclude (text), c.text, substring(kind, 3) as section_type, row_number() over (partition by doc, rn order by isl, chunk) as ordinal from c join p using (doc, rn, isl) where words >= 8),
b as (select *, concat_ws(':', region, coalesce(dept, '-'), section_type) as base from o),
g as (select *, rn > min(rn) over (partition by doc, base) as again from b),
q as (select *, max(case when not again then ordinal end) over (partition by doc, base) as top, row_number() over (partition by doc, base, again order by rn, ordinal) as k from g)
select doc, base || ':' || case when again then top + k else ordinal end as id, cast(page as integer) as pdf_page, region, dept, section_type, heading, cast(ordinal as integer) as ordinal, text from q""")
def narrative_passages(spark, sf):
    """Documents of a source as the pages of a book.  Some pages print a funds title, a mission, items, a
    table or a sub-heading above the text, so that regions come back and every kind of section occurs."""
    n = F.col("doc_id")
    title = F.when(n % 8 == 0, "SOURCE OF FUNDS").otherwise(F.upper("source"))
    head = (F.when(n % 4 == 1, F.concat(F.lit("MISSION: to serve the people of "), "source", F.lit(" well and on time.")))
            .when(n % 4 == 2, "SERVICE HIGHLIGHTS").when(n % 12 == 3, "BUDGET SUMMARY"))
    items = F.when(n % 4 == 2, F.concat(F.lit("•\nRepaired "), n.cast("string"), F.lit(" streets and bridges across all wards of the city this year.\n•")))
    sub = F.when(n % 5 == 0, "Street Work and Lighting")
    book = F.col("source").alias("doc")
    d = table(spark, sf, "documents").select(book, (n + 11).cast("int").alias("page"), "source",
                                             F.concat_ws("\n", title, head, items, sub, F.coalesce("text", F.lit(""))).alias("text"))
    depts = d.select("doc", "page", F.col("source").alias("dept"), F.col("source").alias("dept_name"))
    return P.narrative_passages(d.drop("source"), depts, ["doc"]).select("doc", "id", "pdf_page", "region", "dept", "section_type", "heading", "ordinal", "text")
