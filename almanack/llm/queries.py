"""The thin queries op1 .. op13 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm import conversations, decontam, infill, jaccard, language, licenses, mixing, packing, quality, sharding, substring, topk, urlfilter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    out = language.predict(docs, language.train(docs))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    out = quality.scores(docs, quality.train(docs, _t(spark, sf_dir, "labels")))
    return out.select("doc_id", language.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, special=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return sharding.shard(_t(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_t(spark, sf_dir, "embeddings"), every_row=True)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
)
select query_id, rank, vec_id, score
from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s) where rank <= 5
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


#: The stated rules of op8.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_t(spark, sf_dir, "pages"), URL_RULES)


def _op8_sql(rounds: int = 20) -> str:
    """The same scores by unrolled rounds (links are seldom, so few hosts meet)."""
    host = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = ["select *, case"]
    for kind in ("rule", "own"):
        for verdict, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])):
            own.append(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p if kind == 'rule' else verdict}'")
        own.append(f"end as {kind}" + (", case" if kind == "rule" else " from p"))
    parts = [
        "t as (select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as tail from pages)",
        f"p as (select page_id, html, {host.format('tail')} as host, regexp_extract(substr(tail, 1 + length(regexp_extract(tail, '^[^/?#]*'))), '^[^?#]*') as path from t)",
        "r as (" + " ".join(own) + ")",
        "l as (select host as src, unnest(regexp_extract_all(regexp_replace(html, '{}', ' ', 'g'), '{}', 1)) as link from p)".format(*(x.replace("'", "''") for x in (urlfilter.SILENT, urlfilter.LINK))),
        f"e as (select src, dst, count(*) as w from (select src, {host.format('substr(link, strpos(link, chr(47) || chr(47)) + 2)')} as dst from l) where src <> dst and src <> '' and dst <> '' group by all)",
    ]
    for kind, a, b in (("allow", "src", "dst"), ("block", "dst", "src")):
        parts.append(f"{kind}_s as (select host, 0.15 * count(*) / (select count(*) from r where own = '{kind}' and host <> '') as s from r where own = '{kind}' and host <> '' group by host)")
        parts.append(f"{kind}_e as (select {a} as src, {b} as dst, 0.85 * w / sum(w) over (partition by {a}) as w from e)")
        parts.append(f"{kind}_0 as materialized (select * from {kind}_s)")
        for k in range(rounds):
            parts.append(f"{kind}_{k + 1} as materialized (select host, sum(s) as s from (select * from {kind}_s union all select dst, s * w from {kind}_{k} join {kind}_e on host = src) group by host)")
    parts.append(f"bad as (select host from allow_{rounds} x full join block_{rounds} y using (host) where coalesce(y.s, 0) > 0.5 * (coalesce(x.s, 0) + coalesce(y.s, 0)))")
    return "with " + ", ".join(parts) + " select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(own, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from r"


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(_t(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.JaccardJoin(_t(spark, sf_dir, "documents")).members()


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "select rid, doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n from d"


def _run(size: int) -> str:
    return f"string_agg(w, ' ') over (partition by rid order by pos rows between current row and {size - 1} following)"


OP7_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select row_number() over () as rid, item_id as doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select rid, doc_id as item, least(n, 13) as k, {_run(13)} as x, pos, n from (select rid, doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n from b) y),
items as (select distinct item, k, x from bw where pos <= n - k + 1),
w as ({_WORDS}),
win as (select rid, pos, 13 as k, {_run(13)} as x, n from w union all
  select rid, unnest(range(1, len(ws) - k + 2)) as pos, k, null as x, len(ws) as n from d, (select distinct k from items where k < 13) s where len(ws) >= k),
found as (select win.rid, win.pos, win.k, items.item from win join d on d.rid = win.rid and win.pos <= win.n - win.k + 1
  join items on items.k = win.k and items.x = coalesce(win.x, array_to_string(ws[win.pos:win.pos + win.k - 1], ' '))),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(pos, pos + k)) as p from found) h group by rid),
ids as (select rid, count(*) as n_items, string_agg(i, ',' order by i) as i from (select distinct rid, cast(item as varchar) as i from found where item is not null) f group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(i, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(ws) as contaminated
from d left join hit using (rid) left join ids using (rid)
"""

OP9_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as ({_WORDS}),
win as (select rid, pos, case when pos <= n - 34 then {_run(35)} end as x from w),
again as (select x from win where x is not null group by x having count(*) > 1),
flagged as (select w.rid, w.pos, w.w, max(case when again.x is not null then 1 else 0 end) over (partition by w.rid order by w.pos rows between 34 preceding and current row) as gone
  from w join win on win.rid = w.rid and win.pos = w.pos left join again on again.x = win.x),
kept as (select rid, sum(gone) as n_removed, string_agg(w, ' ' order by pos) filter (where gone = 0) as k from flagged group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from d left join kept using (rid)
"""

OP10_SQL = rf"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as ws from documents),
w as ({_WORDS}),
s as (select distinct rid, x from (select rid, {_run(5)} as x, pos, n from w) y where pos <= greatest(n - 4, 1)),
size as (select rid, count(*) as n from s group by rid),
p as (select a.rid as a, b.rid as b, count(*) as c from s a join s b on a.x = b.x and a.rid < b.rid group by 1, 2),
l as (select a, b from p join size x on x.rid = a join size y on y.rid = b where 100 * c >= 80 * (x.n + y.n - c)),
sides as (select a, b from l union all select b, a from l),
reach as (select rid as a, rid as b from d union select r.a, e.b from reach r join sides e on r.b = e.a),
low as (select r.a as rid, min(d.doc_id) as low from reach r join d on d.rid = r.b group by r.a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, low as component_id from d left join size using (rid) join low using (rid)
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.infilled(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(infill.restored(F.col("form"), F.col("output")), 256)}
    return out.withColumns(digest).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
draws as (select *, len(u) as n, [cast('0x' || substr(h, 1 + 8 * i, 8) as bigint) for i in range(4)] as x from d),
cuts as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 100 then 'plain' when x[4] % 100 < 50 then 'spm' else 'psm' end as form from draws),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cuts)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parts
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations")
    ids = rows.select("conv_id").distinct().withColumn("conv", conversations.conversation())
    done = conversations.repaired(conversations.damaged(rows))
    out = ids.join(done.audits, "conv", "left").join(conversations.digests(done.messages), "conv", "left")
    longs = [F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_t(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
g as (select doc_id, source, size, count(*) as n from d group by all),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
limits as (select *, [3, 1, 2][rank % 3 + 1] as weight, 2 * source_size as most, (select sum(source_size) from s) as total from w),
water as (select *, (1.5::double * total::double - coalesce(sum(most) over before, 0)::double) / (sum(weight) over after)::double as level from limits
  window before as (order by most::double / weight, rank rows between unbounded preceding and 1 preceding), after as (order by most::double / weight, rank rows between current row and unbounded following)),
stop as (select level from water where most > level * weight order by most::double / weight, rank limit 1),
goal as (select source, rank, source_size, case when coalesce(most <= (select level from stop) * weight, true) then most::double else (select level from stop) * weight end as target, total from limits),
blocks as (select doc_id, source, size, n, unnest(range((n + 999) // 1000)) as block from g),
turns as (select *, least(1000, n - 1000 * block) as copies, md5('13:' || coalesce(cast(doc_id as varchar), '') || case when block > 0 then ':' || block else '' end) as turn from blocks),
q as (select *, coalesce(sum(size * copies) over (partition by source order by turn, doc_id nulls first, size, block rows between unbounded preceding and 1 preceding), 0) as queued from turns),
each as (select q.*, unnest(range(copies)) as copy, rank, source_size, target, total, greatest(1, floor(target * 0.01))::bigint as quantum from q join goal on q.source is not distinct from goal.source),
docs as (select row_number() over () as rid, * from each),
passes as (select *, unnest([0, 1]) as turn_no from docs where size > 0 and target > 0),
starts as (select *, unnest(range(0, size, quantum)) as start from passes),
p as (select rid, rank, total, queued + copy * size + turn_no * source_size + start as place, least(quantum, size - start) as words, target from starts),
f as (select *, (place + words)::double / target as finish from p),
c as (select *, coalesce(sum(words) over (order by finish, rank, place rows between unbounded preceding and 1 preceding), 0) as sum_before from f),
t as (select rid, cast(sum(least(words, greatest(0, floor(1.5 * total) - sum_before))) as bigint) as taken from c group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken from docs left join t using (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_license_scan": op1_license_scan, "op2_language_id": op2_language_id, "op3_quality": op3_quality, "op4_packing": op4_packing, "op5_sharding": op5_sharding, "op6_topk": op6_topk, "op7_decontamination": op7_decontamination, "op8_url_filter": op8_url_filter, "op9_substring_dedup": op9_substring_dedup, "op10_jaccard_join": op10_jaccard_join, "op11_fill_in_middle": op11_fill_in_middle, "op12_conversation_repair": op12_conversation_repair, "op13_source_mix": op13_source_mix}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_url_filter": _op8_sql(), "op9_substring_dedup": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op13_source_mix": OP13_SQL}
