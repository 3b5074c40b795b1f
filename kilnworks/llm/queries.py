"""One query for each corpus operator, over whole tables with production parameters, and its SQL where SQL can state it."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import chat_rotation, decontaminate, filter_audit, jaccard, lm_scoring, packing, quality_rules, secrets, substring_dedup, token_counts, token_files, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int):
    """The remainder that decides which rows are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(_fold(4) != 2))
    made = toxicity.score(docs, model)
    return made.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return made.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = quality_rules.apply_rules(docs, carry=["doc_id"])
    return made.withColumns({x: F.round(x, 9) for x in ("char_distance", "word_distance")})


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat_rotation.rotate(_table(spark, sf_dir, "conversations"))
    return made.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ","))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), _fold(7) == 2)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.col("spans")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.as_text(spans, secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.as_text(spans).alias("spans"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "n_words")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_chat_rotation": op4_chat_rotation,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_token_files": op12_token_files,
    "op13_filter_audit": op13_filter_audit,
}


def _list(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}]"


_COMMON = " ".join(f"when '{k}' then {_list(v)}" for k, v in quality_rules.COMMON_WORDS.items())
_PARTS = ", ".join("cast(len(regexp_extract_all(t, '" + x.replace("'", "''").replace('\\"', '"') + "')) as double)" for x in quality_rules.CLASSES.values())
_JS = "sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda k: case when {p}[k] > 0 then {p}[k] * log2(2 * {p}[k] / ({p}[k] + {q}[k])) else 0 end + case when {q}[k] > 0 then {q}[k] * log2(2 * {q}[k] / ({p}[k] + {q}[k])) else 0 end)) / 2, 0))"

OP3_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, case when lang in ('de', 'en', 'es', 'fr') then lang else 'other' end lg from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
b as (select rid, doc_id, lg, ws, len(ws) n_words, length(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines,
  [{_PARTS}] parts, list_transform(case lg {_COMMON} else []::varchar[] end, lambda x: cast(len(list_filter(ws, lambda y: y = x)) as double)) found from w),
runs as (select rid, i, array_to_string(ws[i:i + 4], ' ') s from (select rid, ws, unnest(range(1, n_words - 3)) i from b)),
twins as (select rid, i from (select rid, i, count(*) over (partition by rid, s) c from runs) where c > 1),
covered as (select rid, sum(least(5, coalesce(nxt - i, 5))) n from (select rid, i, lead(i) over (partition by rid order by i) nxt from twins) group by rid),
h as (select b.*, case when word_chars >= 100 then list_transform(list_append(parts, word_chars - list_sum(parts)), lambda x: x / word_chars) end c,
  case when n_words >= 50 then list_transform(list_append(found, n_words - coalesce(list_sum(found), 0)), lambda x: x / n_words) end m from b),
rc as (select lg, list(v order by k) rc from (select lg, k, avg(v) v from (select lg, unnest(range(1, len(c) + 1)) k, unnest(c) v from h where c is not null) group by lg, k) group by lg),
rm as (select lg, list(v order by k) rm from (select lg, k, avg(v) v from (select lg, unnest(range(1, len(m) + 1)) k, unnest(m) v from h where m is not null) group by lg, k) group by lg),
j as (select h.*, coalesce(covered.n, 0) n_repeat_words, case when c is not null then {_JS.format(p="c", q="rc")} end char_distance, case when m is not null then {_JS.format(p="m", q="rm")} end word_distance
  from h left join covered using (rid) left join rc using (lg) left join rm using (lg)),
k as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from j)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
  base_failed, round(char_distance, 9) char_distance, round(word_distance, 9) word_distance, not base_failed and coalesce(char_distance, 0) <= 0.30 and coalesce(word_distance, 0) <= 0.38 kept
from k
"""

OP9_SQL = """
with b as (select distinct item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') ws from benchmark),
i as (select item_id, text, sz, s, count(*) over (partition by item_id, text) n_item
  from (select distinct item_id, text, least(5, len(ws)) sz, array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ') s from (select *, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) k from b where len(ws) > 0))),
d as (select distinct doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') ws from documents),
z as (select distinct sz from i),
g as (select distinct doc_id, text, sz, array_to_string(ws[k:k + sz - 1], ' ') s from (select d.*, sz, unnest(range(1, len(ws) - sz + 2)) k from d, z where len(ws) >= sz)),
p as (select g.doc_id, g.text dt, i.item_id, i.text it, i.n_item, count(*) n_shared from g join i using (sz, s) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item containment from p where n_shared >= 0.75 * n_item
"""

OP6_SQL = """
with recursive d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select distinct rid, array_to_string(ws[k:k + 4], ' ') s from (select rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) k from d where len(ws) > 0)),
n as (select rid, count(*) n from s group by rid),
o as (select a.rid a, b.rid b, count(*) c from s a join s b on a.s = b.s and a.rid <> b.rid group by all),
l as (select a, b from o join n x on x.rid = a join n y on y.rid = b where 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a rid, min(doc_id) least from r join d on d.rid = r.b group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, m.least) component_id from d left join n using (rid) left join m using (rid)
"""

OP4_SQL = """
with m as (select distinct conv_id, coalesce(turn, -(1::bigint << 62)) turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') role, replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') text from conversations),
p as (select *, cast(floor(turn / 256) as bigint) part from m),
v as (select p.*, speaker, case when role = speaker then '<|assistant|>' when role = 'system' then '<|system|>' else '<|user name=' || role || '|>' end || chr(10) head
  from p join (select distinct conv_id c, role speaker from m where role <> 'system') s on p.conv_id is not distinct from s.c),
g as (select *, head || text || '<|end|>' || chr(10) seg from v),
o as (select *, sum(length(seg)) over (partition by conv_id, speaker order by turn, role, text) - length(seg) begins from g)
select conv_id, speaker, part, cast(min(begins) as bigint) as start, cast(count(*) as integer) n_turns, string_agg(seg, '' order by turn, role, text) as text,
  coalesce(string_agg(cast(begins + length(head) as varchar) || ':' || cast(begins + length(seg) as varchar), ',' order by turn, role, text) filter (role = speaker), '') masks
from o group by conv_id, speaker, part
"""

_ORDERS = ", ".join(f"('{''.join(x)}')" for x in permutations(filter_audit.FILTERS))

OP13_SQL = f"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws, min(doc_id) over (partition by t) least from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels where doc_id is not null group by doc_id),
f as (select part, len(ws) < 50 a, 100 * len(list_distinct(ws)) < 65 * len(ws) b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) c, regexp_matches(t, '[#$%&*|]') d,
  coalesce(doc_id > least, false) e, coalesce(good, 0) good, coalesce(toxic, 0) toxic from w left join l using (doc_id)),
m as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int mask, count(*) n, sum(good) good, sum(toxic) toxic from f group by all),
o as (select filter_order, step, 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) own,
  list_sum([0] || [1 << (strpos('ABCDE', substr(filter_order, k, 1)) - 1) for k in range(1, step)]) earlier
  from (values {_ORDERS}) t(filter_order), (select unnest(range(1, 6)) step)),
x as (select part, filter_order, step, n, good, toxic, mask, own, mask & own <> 0 here, mask & cast(earlier as bigint) <> 0 before from m, o)
select part, filter_order, cast(step as integer) step, cast(sum(case when not here and not before then n else 0 end) as bigint) kept, cast(sum(case when here and not before then n else 0 end) as bigint) removed,
  cast(sum(case when here and before then n else 0 end) as bigint) redundant, cast(sum(case when mask = own then n else 0 end) as bigint) unique_fails,
  cast(sum(case when here and not before then good else 0 end) as bigint) good_lost, cast(sum(case when here and not before then toxic else 0 end) as bigint) toxic_lost,
  cast(sum(case when here then n * 120 // bit_count(mask) else 0 end) as bigint) shapley
from x group by part, filter_order, step
"""

ORACLES = {
    "op13_filter_audit": OP13_SQL,
    "op4_chat_rotation": OP4_SQL,
    "op3_quality_rules": OP3_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op9_decontaminate": OP9_SQL,
}
