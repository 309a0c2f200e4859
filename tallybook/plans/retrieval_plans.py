"""Search over documents, embeddings and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook import fixed_values as V
from tallybook.functions.trigrams import word_similarity
from tallybook.operators import retrieval as R
from tallybook.plans import bindings as B
from tallybook.plans.registry import query, table

# Spark's English list, the part of it that keyword_rank can meet: single lower-case words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now").split()
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
STEM = "regexp_replace(regexp_replace({0}, '([a-z][a-z][a-z])ies$', '\\1y'), '([a-z][a-z][a-z])(ing|ed|es|s)$', '\\1')"
TERMS = f"""dt as (select doc_id as id, {STEM.format('w')} as term from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w
    from documents) where w not in ({STOP_SQL})),
dc as (select id, term, count(*) as n from dt group by all),
qt as (select distinct item_id as query_id, {STEM.format('w')} as term from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w
    from benchmark) where w not in ({STOP_SQL})),
ks as (select query_id, id, cast(sum(n) as bigint) as score from dc join qt using (term) group by all),
kw as (select *, row_number() over (partition by query_id order by score desc, id) as rank from ks)"""


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


@query("keyword_rank", f"with {TERMS} select query_id, id, score, cast(rank as integer) as rank from kw where rank <= 20")
def keyword_rank(spark, sf):
    return R.keyword_rank(benchmark_queries(spark, sf), documents(spark, sf), STOP_WORDS)


def centroids(spark, sf):
    """The mean vector of each label: one concept per label."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


CENTROIDS = """c as (select label as query_id, list(m order by i) as v from (select label, i, avg(x::double) as m from (
    select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by label),
vr as (select query_id, vec_id as id, row_number() over (partition by query_id
    order by list_cosine_similarity(embedding::double[], v) desc, vec_id) as rank from c, embeddings)"""


@query("knn", f"with {CENTROIDS} select cast(query_id as bigint) as query_id, id, cast(rank as integer) as rank from vr where rank <= 20")
def knn(spark, sf):
    return R.vector_rank(centroids(spark, sf), corpus(spark, sf)).drop("score")


@query("knn_blocked", f"with {CENTROIDS} select cast(query_id as bigint) as query_id, id, cast(rank as integer) as rank from vr where rank <= 20")
def knn_blocked(spark, sf):
    """The same scan with a query set over the bound: blocks of queries against blocks of the corpus."""
    return R.vector_rank(centroids(spark, sf), corpus(spark, sf), max_queries=4, block_rows=20_000).drop("score")


@query("rrf", f"""with {TERMS}, {CENTROIDS},
k as (select query_id, id, rank from kw where rank <= 20), v as (select query_id, id, rank from vr where rank <= 20),
f as (select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.id, v.id) as id,
    coalesce(1.0::double / (60 + k.rank), 0.0) + coalesce(1.0::double / (60 + v.rank), 0.0) as score
  from k full join v on k.query_id = v.query_id and k.id = v.id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from f)
select cast(query_id as bigint) as query_id, id, score, cast(rank as integer) as rank from r where rank <= 5""")
def rrf(spark, sf):
    kw = R.keyword_rank(benchmark_queries(spark, sf), documents(spark, sf), STOP_WORDS)
    vs = R.vector_rank(centroids(spark, sf), corpus(spark, sf))
    return R.fuse_ranks(kw, vs).drop("kw", "vs")


FOCUS_STOP = ", ".join(f"'{w}'" for w in V.FOCUS_STOP_WORDS)
CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("focus_passage", rf"""with recursive
d as (select doc_id, {CLEAN} as clean, [w for w in list_distinct(regexp_extract_all(lower(right(text, 300)), '[a-z0-9]+')) if length(w) > 2 and w not in ({FOCUS_STOP})] as words from documents),
s as (select doc_id, words, unnest(string_split(regexp_replace(clean, '([.!?])\s+([A-Z0-9•"“(])', '\1' || chr(1) || '\2', 'g'), chr(1))) as t,
    generate_subscripts(string_split(regexp_replace(clean, '([.!?])\s+([A-Z0-9•"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) as i
  from d where length(clean) > 1200),
o as (select doc_id, t, i, row_number() over (partition by doc_id order by len([w for w in regexp_extract_all(lower(t), '[a-z0-9]+') if list_contains(words, w)]) desc, i) as rn from s),
f as (select doc_id, rn, i, t, length(t) <= 1200 as keep, case when length(t) <= 1200 then length(t) + 1 else 0 end as used from o where rn = 1
  union all select o.doc_id, o.rn, o.i, o.t, f.used + length(o.t) <= 1200, case when f.used + length(o.t) <= 1200 then f.used + length(o.t) + 1 else f.used end
  from f join o on o.doc_id = f.doc_id and o.rn = f.rn + 1)
select doc_id, clean as text from d where length(clean) <= 1200
union all select d.doc_id, coalesce(string_agg(case when keep then t end, ' … ' order by i), '') from d join f using (doc_id) group by d.doc_id""")
def focus_passage(spark, sf):
    """Each document cut to the sentences that share most words with its last 300 characters, taken as the question."""
    return table(spark, sf, "documents").select("doc_id", R.focus_passage(F.col("text"), F.expr("right(text, 300)")).alias("text"))


GRAMS = (r"list_transform(flatten([list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)) "
         r"for w in regexp_split_to_array(lower({0}), '[^a-z0-9]+') if w <> '']), lambda x: x)")


def best_run(phrase: str, text: str) -> str:
    """Word similarity of two gram lists, all runs between shared grams."""
    hits = f"[i for i in range(1, len({text}) + 1) if list_contains({phrase}, {text}[i])]"
    score = (f"(len(list_intersect(list_distinct({text}[s:e]), {phrase})) / (len({phrase}) + len(list_distinct({text}[s:e])) "
             f"- len(list_intersect(list_distinct({text}[s:e]), {phrase})))::double)")
    return f"coalesce(list_max(flatten([[{score} for e in {hits} if e >= s] for s in {hits}])), 0.0)"


@query("word_similarity", f"""with n as (select distinct p_name, p_type from part),
g as (select p_name, p_type, list_distinct({GRAMS.format("substring(p_name, 1, 3) || substring(p_name, 5)")}) as a, {GRAMS.format("p_name || ' ' || p_type")} as b from n)
select p_name, p_type, round({best_run('a', 'b')}, 9) as similarity from g""")
def similarity(spark, sf):
    """Every part name with a letter lost, against the name and type printed together."""
    pairs = table(spark, sf, "part").select("p_name", "p_type").distinct()
    phrase = F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"))
    return pairs.select("p_name", "p_type", F.round(word_similarity(phrase, F.concat_ws(" ", "p_name", "p_type")), 9).alias(
        "similarity"))


ADDRESS_SQL = f"""b as (select *, cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer) as brand,
    case p_type when 'STANDARD' then 'ST' when 'MEDIUM' then 'AV' when 'SMALL' then 'LA' when 'LARGE' then 'BL' when 'PROMO' then 'PK' else 'CT' end as kind from part),
pa as (select lpad(p_partkey::varchar, 10, '0') as taxkey, p_partkey, p_size * 100 as lo, p_size * 100 + case when brand > 12 then 4 else 0 end as hi,
    (['N', 'S', 'E', 'W'])[brand % 4 + 1] as dir, upper(p_name) as street, kind from b),
pl as (select lo, hi, dir, street, kind, count(*) as n, min(taxkey) as taxkey, concat_ws(' ', lo::varchar, dir, street, kind) as address from pa group by all),
qs as (select s_suppkey as query_id, lo + 2 as nr, dir as qdir, dir || ' ' || substring(street, 1, 3) || substring(street, 5) || ' ' || kind as phrase
  from supplier join pa on s_suppkey = p_partkey),
ph as (select distinct phrase, list_distinct({GRAMS.format('phrase')}) as a from qs), ad as (select distinct address, {GRAMS.format('address')} as b from pl),
sm as (select phrase, address, {best_run('a', 'b')} as sim from ph, ad where len(list_intersect(a, b)) >= 0.6 * len(a) - 1e-9),
rk as (select query_id, row_number() over (partition by query_id order by (dir = qdir) desc, (nr between lo and hi) desc, sim desc, abs(lo - nr), lo, hi, dir, street, kind) as rank,
    case when n = 1 then taxkey end as taxkey, concat_ws(' ', case when hi <> lo then lo || '-' || hi else lo::varchar end, dir, street, kind) as address,
    nr between lo and hi as exact_number, n as parcels
  from qs join sm using (phrase) join pl using (address) where sim >= 0.6)"""


@query("address_search", f"""with {ADDRESS_SQL}
select query_id, cast(rank as integer) as rank, taxkey, address, exact_number, parcels from rk where rank <= 8""")
def address_search(spark, sf):
    return R.search_addresses(B.typed_addresses(spark, sf), B.street_parcels(spark, sf)).drop("similarity")


@query("glossary_lookup", f"""with e as (select p_name as term, list(distinct p_type) as aliases from part group by p_name),
q as (select distinct t from (select lower(p_type) as t from part union select lower(substring(p_name, 1, 4) || substring(p_name, 6)) from part
    union select 'the ' || p_name || ' line' from part union select split_part(p_name, ' ', 2) from part)),
g as (select t, term, aliases, list_distinct({GRAMS.format('t')}) as a, {GRAMS.format('term')} as b from q, e),
s as (select *, {best_run('a', 'b')} as similarity from g),
r as (select t, term, similarity, row_number() over (partition by t order by similarity desc, term) as rank from s
  where contains(term, t) or contains(t, term) or list_contains([lower(x) for x in aliases], t) or similarity > 0.5)
select t as query_id, term, round(similarity, 9) as similarity, cast(rank as integer) as rank from r where rank <= 3""")
def glossary_lookup(spark, sf):
    """Part names as terms with their types as aliases; typed terms are types, misspelt names, names in a phrase, and nouns."""
    p = table(spark, sf, "part")
    entries = p.select(F.col("p_name").alias("term"), "p_type").distinct().groupBy("term").agg(
        F.collect_list("p_type").alias("aliases"))
    typed = F.array(F.lower("p_type"), F.lower(F.concat(F.substring("p_name", 1, 4), F.expr("substring(p_name, 6)"))),
                    F.concat(F.lit("the "), "p_name", F.lit(" line")), F.split_part("p_name", F.lit(" "), F.lit(2)))
    asked = p.select(F.explode(typed).alias("query_id")).distinct().withColumn("typed", F.col("query_id"))
    return R.lookup_glossary(asked, entries).select("query_id", "term", F.round("similarity", 9).alias("similarity"), "rank")


@query("recall_mrr", rf"""with {TERMS}, x as (select item_id as query_id, doc_id as id from benchmark join documents on contains(documents.text, benchmark.text)),
h as (select x.query_id, min(rank) as first from x left join (select * from kw where rank <= 5) k on k.query_id = x.query_id and k.id = x.id group by 1)
select count(*) as queries, avg(case when first is not null then 1.0::double else 0.0::double end) as recall,
  round(avg(coalesce(1.0::double / first, 0.0::double)), 9) as mrr from h""")
def recall_mrr(spark, sf):
    """Benchmark passages looked up in documents; the documents that print a passage word for word are expected.
    Candidates for that test share the passage's inner words, eight of them at most, found by a hash join on shingles of as
    many words.  A passage may start and end inside a token of the document, so its first and last word are no part of it."""
    q, d = benchmark_queries(spark, sf), documents(spark, sf)
    run = lambda t, i, n: F.array_join(F.slice(t, i, n), " ")
    tokens = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    qw = q.select("query_id", F.col("text").alias("passage"), tokens(F.col("text")).alias("w"))
    # A passage of one or two words has no inner ones and is expected where it stands as whole words.
    short = F.size("w") <= 2
    qw = qw.where(F.size("w") > 0).withColumn("n", F.when(short, F.size("w")).otherwise(F.least(F.size("w") - 2, F.lit(8))))
    qw = qw.select("query_id", "passage", "n", F.when(short, F.array_join("w", " ")).otherwise(run(F.col("w"), 2, F.col("n"))).alias("key"))
    # The lengths that occur, eight at most, are known before any document is cut.
    lengths = qw.agg(F.collect_set("n")).scalar()
    dw = d.select("id", tokens(F.col("text")).alias("w"), F.explode(lengths).alias("n"))
    starts = F.when(F.size("w") >= F.col("n"), F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    shingles = dw.select("id", "n", "w", F.explode(starts).alias("i")).select("id", "n", run(F.col("w"), F.col("i"), F.col("n")).alias("key"))
    pairs = shingles.join(qw, ["n", "key"]).select("query_id", "id", "passage").distinct().join(d.select("id", "text"), "id")
    expected = pairs.where(F.col("text").contains(F.col("passage"))).select("query_id", "id")
    return R.recall_and_mrr(R.keyword_rank(q, d, STOP_WORDS), expected, k=5).withColumn("mrr", F.round("mrr", 9))


@query("search_passages", f"""with {TERMS}, r as (select query_id, id, row_number() over (partition by query_id order by 1.0::double / (60 + rank) desc, id) as rank
  from kw where rank <= 20)
select query_id, cast(r.rank as integer) as rank, r.id, d.source as context from r join documents d on d.doc_id = r.id where r.rank <= 5""")
def search_passages(spark, sf):
    """Benchmark texts as questions without vectors: the keyword list stands alone."""
    pool = documents(spark, sf).select("id", "text", F.lit("narrative").alias("kind"), F.lit(None).cast("string").alias("heading"),
                                       F.concat_ws(" — ", F.lit("City"), "source").alias("context_header"), F.lit(1).alias("cite"))
    return R.search_passages(benchmark_queries(spark, sf), pool, STOP_WORDS).select("query_id", "rank", "id", "context")


@query("hybrid_search", rf"""with {TERMS}, e as (select vec_id as id, embedding::double[] as v from embeddings),
vs as (select q.id as query_id, e.id, row_number() over (partition by q.id order by list_cosine_similarity(e.v, q.v) desc, e.id) as rank
  from e q join benchmark on item_id = q.id, e join documents on doc_id = e.id),
f as (select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.id, v.id) as id, coalesce(1.0::double / (60 + k.rank), 0.0) + coalesce(1.0::double / (60 + v.rank), 0.0) as score
  from (select * from kw where rank <= 20) k full join (select * from vs where rank <= 20) v on k.query_id = v.query_id and k.id = v.id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from f)
select query_id, cast(rank as integer) as rank, r.id, score, d.source as context, length({CLEAN.replace('text', 'd.text')}) <= 1200 as whole,
  case when length({CLEAN.replace('text', 'd.text')}) <= 1200 then {CLEAN.replace('text', 'd.text')} end as text from r join documents d on d.doc_id = r.id where r.rank <= 5""")
def hybrid_search(spark, sf):
    """Benchmark texts as questions, with the vector of their number, against documents with the vectors of theirs: keyword and
    vector lists fused over one id space.  Texts that are not cut are compared whole."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pool = documents(spark, sf).select("id", "text", F.lit("narrative").alias("kind"), F.lit(None).cast("string").alias("heading"),
                                                                  F.concat_ws(" — ", F.lit("City"), "source").alias("context_header"), F.lit(1).alias("cite"))
    asked = benchmark_queries(spark, sf).join(vectors.withColumnRenamed("id", "query_id"), "query_id", "left")
    found = R.search_passages(asked, pool, STOP_WORDS, vectors=vectors)
    whole = found.join(documents(spark, sf).select("id", F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("_n")), "id")
    return whole.select("query_id", "rank", "id", "score", "context", (F.col("_n") <= 1200).alias("whole"), F.when(F.col("_n") <= 1200, F.col("text")).alias("text"))


REVIEWED = TERMS.replace("from documents)", "from documents join labels using (doc_id) where quality = 1)")


@query("find_facts", f"""with {REVIEWED},
r as (select query_id, id, rank from kw where rank <= 4) select query_id, id, cast(rank as integer) as rank from r""")
def find_facts(spark, sf):
    """Labelled documents as facts; good ones are reviewed."""
    facts = documents(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").select(
        "id", F.lit("").alias("topic"), F.col("text").alias("statement"), F.when(F.col("quality") == 1, "a person").alias("reviewed_by"))
    return R.find_facts(benchmark_queries(spark, sf), facts, STOP_WORDS).select("query_id", "id", "rank")
