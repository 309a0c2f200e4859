"""The registered queries of the operators, with production parameters over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import chat, pii, quality, secrets, toxicity
from tallybook.llm.common import ascii_lower, table
from tallybook.llm.decontamination import contaminated
from tallybook.llm.exact_dedup import exact_dedup
from tallybook.llm.mixing import mix_sources
from tallybook.llm.ngram_join import near_duplicates
from tallybook.llm.resampling import importance_resample
from tallybook.llm.samples import fold
from tallybook.llm.substring_dedup import substring_dedup
from tallybook.llm.target_ratio import BUCKETS, PAIR, target_ratio_filter
from tallybook.llm.whitening import whiten


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    field = toxicity.fit_toxicity(docs, labels, "toxic", fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, field)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_spans", "spans")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def span_columns(kinds: tuple[str, ...]) -> list[Column]:
    """Counts of base spans, their digest, and all spans, by start, then base kinds as listed, then the method's."""
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    place = lambda x: F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), x["kind"]), F.lit(0))
    ranked = F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), F.when(place(x) == 0, len(kinds) + 1).otherwise(place(x)).alias("at"),
                                                                         x["end"].alias("end"), x["kind"].alias("kind")))
    return [*counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(ranked)).alias("spans")]


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *span_columns(secrets.KINDS))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    trees = quality.fit_quality(docs, labels, "quality", fold("doc_id", 3) != 1)
    return quality.score_quality(docs, trees).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.train(*pii.training_windows(docs))
    return pii.find_personal_data(docs, model).select("doc_id", *span_columns(pii.KINDS))


def op7_chat(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("select stack(2, -7L, 0L, 'user', :said, -7L, 1L, 'assistant', :said) as (conv_id, turn, role, text)", args={"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    packed, members = chat.prefix_tree(rows, vocabulary, pattern)
    return chat.read_back(packed, members, vocabulary, pattern)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "items")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_ratio_filter(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_chat": op7_chat,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The table of CRC-32 (reflected polynomial 0xEDB88320) and the CRC of each word of a relation `words` (word).
CRC_TABLE = "crc_table as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t)"
CRC_OF = """crcs as (select word, xor(list_reduce(list_concat([4294967295::bigint], octets), lambda c, k: xor(c >> 8, t[1 + (xor(c, k) & 255)])), 4294967295) as crc
                 from (select word, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint) as octets
                       from (select word, hex(encode(word)) as h from words)), crc_table)"""

ORACLES: dict[str, str] = {
    "op11_quality_rules": rf"""
        with {CRC_TABLE},
             d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
             tokens as (select r, unnest(w) as word, unnest(range(len(w))) as i from d),
             words as (select distinct word from tokens),
             {CRC_OF},
             c as (select r, i, word, crc, lead(crc) over by_place as crc2, lead(word) over by_place as w2, lead(word, 2) over by_place as w3
                   from tokens join crcs using (word) window by_place as (partition by r order by i)),
             runs as (select r, i, count(*) over (partition by r, word, w2, w3) as n from c where w3 is not null),
             rep as (select r, count(distinct i + k) as n_repeat_words from runs, range(3) as x(k) where n > 1 group by r),
             f as (select r, bucket, count(*) as k from (select r, crc % {BUCKETS} as bucket from c union all
                                                        select r, (crc * {PAIR} + crc2) % {BUCKETS} from c where crc2 is not null) group by r, bucket),
             good as (select doc_id from labels where doc_id is not null group by doc_id having min(quality) = 1),
             g as (select d.r, d.doc_id in (select doc_id from good) as good from d),
             fg as (select f.*, coalesce(g.good, false) as good from f join g using (r)),
             counts as (select bucket, sum(k)::bigint as s, coalesce(sum(k) filter (where good), 0)::bigint as t from fg group by bucket),
             sizes as (select sum(s)::bigint as all_s, sum(t)::bigint as all_t from counts),
             n as (select r, sum(k)::bigint as n from f group by r),
             ratios as (select fg.r, any_value(good) as good, (sum(k * floor(1000 * ln(((t - if(good, k, 0) + 1)::double * (all_s - n + {BUCKETS})::double)
                                    / ((s - k + 1)::double * (all_t - if(good, n, 0) + {BUCKETS})::double)))::bigint) / any_value(n)) as mean
                        from fg join counts using (bucket) join n using (r), sizes group by fg.r),
             lines as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
             s as (select d.r, d.doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
                          length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
                          coalesce(n_repeat_words, 0) as n_repeat_words, floor(mean)::bigint as ratio, coalesce(good, false) as good
                   from d left join lines using (r) left join rep using (r) left join ratios using (r)),
             b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
             cut as (select list_sort(list(ratio))[1 + floor(count(*) * 0.002)::int] as least from b where good and not base_failed)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, coalesce(not base_failed and (least is null or ratio >= least), false) as kept from b, cut
    """,
    "op13_resampling": rf"""
        with {CRC_TABLE},
             d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
             b as (select unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
             tokens as (select r, unnest(w) as word from d),
             words as (select word from tokens union select word from b),
             {CRC_OF},
             s as (select crc % 10000 as bucket, count(*) as s from tokens join crcs using (word) group by 1),
             t as (select crc % 10000 as bucket, count(*) as t from b join crcs using (word) group by 1),
             z as (select (select coalesce(sum(s), 0) from s)::double as all_s, (select coalesce(sum(t), 0) from t)::double as all_t),
             gains as (select s.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from s left join t using (bucket), z),
             sums as (select r, sum(gain)::bigint as weight from tokens join crcs using (word) join gains on gains.bucket = crcs.crc % 10000 group by r),
             scored as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
                               (('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint as score from d left join sums using (r)),
             ranked as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place from scored)
        select doc_id, n_features, weight, score, case when place <= (select count(*) from scored where n_features >= 20) * 10 // 100 then place end as rank from ranked
    """,
    "op8_exact_dedup": f"""
        with t as (select doc_id, {LOWER} as norm from documents),
             g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g using (norm)
    """,
    "op9_substring_dedup": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
             s as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35),
             h as (select doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) as h from s),
             r as (select doc_id, i from h where h in (select h from h group by h having count(*) > 1)),
             c as (select distinct doc_id, unnest(range(i, i + 35)) as k from r),
             g as (select doc_id, list(k) as gone from c group by doc_id),
             k as (select d.doc_id, d.w, coalesce(g.gone, []) as gone from d left join g using (doc_id)),
             p as (select doc_id, len(w) as n_words, len(gone) as n_removed, unnest(case when len(w) = 0 then [NULL] else w end) as word,
                          unnest(case when len(w) = 0 then [0] else range(1, len(w) + 1) end) as pos from k),
             kept_words as (select p.doc_id, any_value(n_words) as n_words, any_value(n_removed) as n_removed,
                                  string_agg(word, ' ' order by pos) filter (where c.k is null and word is not null) as kept
                           from p left join c on p.doc_id = c.doc_id and p.pos = c.k group by p.doc_id)
        select doc_id, n_words, n_removed, sha256(coalesce(kept, '')) as kept_sha256 from kept_words
    """,
    "op4_mixing": r"""
        with d as (select doc_id, coalesce('s' || source, 't') as src, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as z, coalesce(text, '') as text,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                          -ln((('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|17'), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
                          / (0.5 + length(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g'))::double / greatest(length(coalesce(text, '')), 1)) as key,
                          coalesce(cast(doc_id as varchar), '') as tag from documents),
             s as (select src, sum(size)::bigint as source_size, row_number() over (order by src) - 1 as n from d group by src),
             w as (select *, [3.0::double, 1.0::double, 2.0::double][1 + n % 3] as share, 2.0::double * source_size as most from s),
             o as (select *, 1.5::double * sum(source_size) over () as everything,
                          coalesce(sum(most) over (order by most / share, n rows between unbounded preceding and 1 preceding), 0) as used,
                          sum(share) over (order by most / share, n rows between current row and unbounded following) as open from w),
             f as (select *, most * open <= (everything - used) * share as is_full from o),
             l as (select (everything - used) as words, open as shares from f where not is_full order by most / share, n limit 1),
             t as (select src, source_size, case when is_full then most else least(most, (select words from l) * share / (select shares from l)) end as target from f),
             e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
             r as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
                          sum(d.size) over (partition by d.src order by key, tag, d.size rows between unbounded preceding and current row) as running from d join e using (src))
        select doc_id, size, source_size, target, (size * (epochs + case when rest > 0 and running - size / 2 <= rest then 1 else 0 end))::bigint as taken from r
    """,
}
