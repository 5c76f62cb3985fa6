"""Registry of the engine's own queries, each over whole tables, and their oracle SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import annotate as A
from ..operators import corpus as C
from ..operators import facts as K
from ..operators import insights as I
from ..operators import modes as M
from ..operators import planning as P
from ..operators import relevance as R
from ..operators import resolve as Z
from ..operators import rows as V
from ..operators import store as U
from ..operators import summaries as S
from ..operators import telemetry as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d(x: str, n: int = 4) -> str:
    """SQL of the rounding that text.rnd applies."""
    return f"cast(round(cast({x} as decimal(18,6)),{n}) as double)"


def words(x: str) -> str:
    """SQL of text.ascii_tokens."""
    return f"regexp_split_to_array(lower(coalesce({x},'')),'[^a-z0-9]+')"


def quoted(terms: list[str]) -> str:
    return ",".join(f"'{t}'" for t in terms)


_rx = "|".join(L.REQUESTS)


def requests_sql(x: str) -> str:
    """SQL of annotate.requests: the first three sentences that match a request pattern, cut to 300 characters."""
    cut = f"regexp_split_to_array(regexp_replace(coalesce({x},''),'([.!?。！？])[ \\t\\n\\x0B\\f\\r]*',e'\\\\1\\n','g'),'\\n+')"
    return f"list_transform(list_filter(list_filter(list_transform({cut}, lambda x: trim(x, ' ')), lambda x: x<>''), lambda x: regexp_matches(lower(x),'{_rx}'))[1:3], lambda x: substr(x,1,300))"


# --- shared relations -------------------------------------------------------------------------------------------------------------
def orders_voice(spark, sf):
    """Orders as dated voice rows: topic, source, time, negative."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("topic"), F.col("c_mktsegment").alias("source"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("negative"), "o_totalprice", "o_orderkey")


ORDERS_VOICE = "select o_orderpriority topic, c_mktsegment source, o_orderdate tm, o_orderstatus='F' negative, o_totalprice, o_orderkey from orders join customer on o_custkey=c_custkey"


def voices(spark, sf):
    """Evidence as it stands after upserts (the last row of each evidence_id), annotated, with the position of each voice."""
    e = load(spark, sf, "evidence").filter("evidence_id is not null")
    e = S.keep_last(e.select("evidence_id", "ingest_seq", "source", "game_id", "relevance_label", "access_scope", "evidence_kind", "payload_json"), ["evidence_id"], "ingest_seq")
    field = lambda k: F.get_json_object("payload_json", f"$.{k}")
    e = e.select("*", field("original_text").alias("text"), field("recommended").cast("boolean").alias("recommended"), F.try_to_timestamp(field("published_at")).alias("published_at")).drop("payload_json")
    return I.positioned(A.annotate(e))


def members(spark, sf):
    """The insight corpus with one row for each topic of a voice."""
    return I.memberships(I.corpus(voices(spark, sf)))


def _levelled() -> tuple[str, str]:
    """Characters with a compatibility form of one other character, and those forms, for SQL."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for r in (range(0xA0, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800)) for c in r]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs).replace("'", "''")


_FROM, _TO = _levelled()


def norm(x: str) -> str:
    """SQL of text.normalise, as far as characters with a form of several characters do not matter."""
    return f"trim(regexp_replace(lower(replace(nfc_normalize(translate(coalesce({x},''),'{_FROM}','{_TO}')),'ß','ss')),'\\s+',' ','g'))"


_DOUBLE = "regexp_replace(' '||norm||' ','([^a-z0-9])','\\1\\1','g')"  # boundaries doubled, so that neighbouring matches do not share one
_phrase = lambda t: f"'[^a-z0-9]{t.replace(' ', '  ')}[^a-z0-9]'"


def sql_count(terms: list[str]) -> str:
    """SQL of text.term_count over norm, toks and dbl."""
    words_ = [t for t in terms if T.is_word(t)]
    parts = [f"len(list_filter(toks, lambda t: t in ({quoted(words_)})))"] if words_ else []
    parts += [f"len(regexp_extract_all(dbl,{_phrase(t)}))" if t.isascii() else f"(length(norm)-length(replace(norm,'{t}','')))//{len(t)}" for t in terms if not T.is_word(t)]
    return "(" + "+".join(parts) + ")"


def sql_has(t: str) -> str:
    return f"list_contains(toks,'{t}')" if T.is_word(t) else f"regexp_matches(dbl,{_phrase(t)})" if t.isascii() else f"contains(norm,'{t}')"


def _first(terms: list[str]) -> str:
    return "least(" + ",".join(f"case when {sql_has(t)} then strpos(norm,'{t}') end" for t in terms) + ")"


_present = lambda terms: "+".join(f"({sql_has(t)})::int" for t in terms)
VOICES = f"""
with base as (select ingest_seq, evidence_id, source, game_id, relevance_label, access_scope, evidence_kind, json_extract_string(payload_json,'$.original_text') as txt,
  cast(json_extract_string(payload_json,'$.recommended') as boolean) recommended, try_cast(json_extract_string(payload_json,'$.published_at') as timestamptz) published_at
  from evidence where evidence_id is not null qualify row_number() over(partition by evidence_id order by ingest_seq desc)=1),
nrm as (select *, {norm('txt')} norm from base),
tok as (select *, regexp_split_to_array(norm,'[^a-z0-9]+') toks, {_DOUBLE} dbl from nrm),
cnt as (select *, list_sort(list_filter([{','.join("{'neg': -cast(" + sql_count(v) + " as bigint), 'at': " + _first(v) + f", 'topic': '{k}'" + '}' for k, v in sorted(L.TOPICS.items()))}], lambda x: x.neg < 0)) ranked,
  {_present(L.POSITIVE)} pos, {_present(L.NEGATIVE)} neg, {_present(L.NEUTRAL)} neu from tok),
lab as (select *, coalesce(ranked[1].topic,'unknown') as prim, coalesce(-ranked[1].neg,0) as hits,
  case when pos>0 and neg>0 then 'mixed' when pos>0 then 'positive' when neg>0 then 'negative' when neu>0 then 'neutral' else 'unknown' end as sentiment from cnt),
voices as (select *, list_transform(list_filter(list_slice(ranked,2,99), lambda x: -x.neg >= greatest(1, hits//2))[1:4], lambda x: x.topic) secondary,
  coalesce(case when recommended then 'positive' when not recommended then 'negative' end, sentiment) as "position",
  case when recommended is not null then 'source_native_recommendation' else 'inferred_bilingual_lexicon' end as "method" from lab)
"""
MEMBERS = VOICES + f""", corp as (select * from voices where access_scope='public' and relevance_label='relevant' and evidence_kind in ({quoted(I.COMMUNITY_KINDS)})),
mem as (select *, unnest(list_distinct(list_concat([prim], secondary))) topic from corp)
"""


# --- summaries --------------------------------------------------------------------------------------------------------------------
@query(f"""select source, count(*) records, min(epoch_us(updated_at)) first_us, max(epoch_us(updated_at)) last_us,
 {d("sum(case when relevance_label='irrelevant' then 1 else 0 end)::double/count(*)")} negative_share, cast(sum(length(payload_json)) as bigint) engagement from evidence group by 1""")
def source_summary(spark, sf):
    return S.source_summary(load(spark, sf, "evidence"), ["source"], F.col("relevance_label") == "irrelevant", F.char_length("payload_json").cast("bigint"), "updated_at")


@query(VOICES + f"select prim topic, source, count(*) records, {d('sum(case when sentiment=' + chr(39) + 'negative' + chr(39) + ' then 1 else 0 end)::double/count(*)')} negative_share from voices group by 1,2")
def topic_by_source(spark, sf):
    v = voices(spark, sf)
    return v.groupBy(F.col("primary").alias("topic"), "source").agg(F.count("*").alias("records"), T.ratio(F.sum(F.when(F.col("sentiment") == "negative", 1).otherwise(0)), F.count("*")).alias("negative_share"))


@query(f"""with v as ({ORDERS_VOICE}), a as (select max(tm) anchor from v),
p as (select v.*, case when tm>=anchor-interval 365 day then 'recent' when tm>=anchor-interval 730 day then 'prior' else 'older' end period from v, a),
g as (select topic, count(*) records, cast(sum(case when negative then 1 else 0 end) as bigint) negatives, count(distinct source) sources,
 cast(sum(case when period='recent' then 1 else 0 end) as bigint) recent, cast(sum(case when period='prior' then 1 else 0 end) as bigint) prior from p group by 1),
h as (select *, {d('records::double/sum(records) over()')} as "share", {d('negatives::double/records')} negative_share,
 {d('(recent::double/greatest(1,sum(recent) over())+0.005)/(prior::double/greatest(1,sum(prior) over())+0.005)')} momentum,
 records::double/greatest(1,max(records) over()) vr from g),
s as (select topic, records, negatives, sources, recent, prior, "share", negative_share, momentum,
 cast((vr>=0.15)::int+(vr>=0.35)::int+(vr>=0.65)::int as int) volume_score, cast((negative_share>=0.2)::int+(negative_share>=0.4)::int+(negative_share>=0.6)::int as int) negative_score,
 cast(case when recent+prior>=5 then (momentum>=1.05)::int+(momentum>=1.3)::int+(momentum>=1.75)::int else 0 end as int) momentum_score, cast(least(3,sources) as int) breadth_score from h),
t as (select *, cast(volume_score+negative_score+momentum_score+breadth_score as int) priority_score from s)
select *, case when priority_score>=10 then 'P0' when priority_score>=7 then 'P1' when priority_score>=4 then 'P2' else 'P3' end priority from t""")
def topic_priority(spark, sf):
    return S.topic_priority(orders_voice(spark, sf), "topic", "source", "at", F.col("negative"), 365)


@query(f"""with v as ({ORDERS_VOICE}), r as (select topic, o_orderkey, o_totalprice, cast(row_number() over(partition by topic order by o_totalprice desc, tm desc, o_orderkey) as int) rank from v where negative)
select * from r where rank<=3""")
def negative_excerpts_topk(spark, sf):
    v = orders_voice(spark, sf).filter("negative")
    return S.top_per_group(v, ["topic"], [F.desc("o_totalprice"), F.desc("at"), F.col("o_orderkey")], 3).select("topic", "o_orderkey", "o_totalprice", "rank")


@query(f"""with v as ({ORDERS_VOICE}), a as (select max(tm) anchor from v)
select case when tm>=anchor-interval 30 day then 'recent' when tm>=anchor-interval 60 day then 'prior' else 'older' end period, topic, count(*) n from v, a group by 1,2""")
def period_label(spark, sf):
    return S.period_label(orders_voice(spark, sf), "at").groupBy("period", "topic").agg(F.count("*").alias("n"))


@query(MEMBERS + f""", ok as (select unnest(json_keys(source_status)) source, source_status from runs), el as (select distinct source from ok where json_extract_string(source_status,'$.'||source||'.status') in ('collected','partial')),
anc as (select game_id, topic, max(published_at) anchor from mem group by 1,2),
g as (select m.game_id, m.topic, count(*) items, cast(sum(("position"='negative')::int) as bigint) negatives, cast(sum(case when published_at>=anchor-interval 30 day then 1 else 0 end) as bigint) recent,
 cast(sum(case when published_at>=anchor-interval 60 day and published_at<anchor-interval 30 day then 1 else 0 end) as bigint) prior, count(distinct el.source) breadth
 from mem m join anc using(game_id, topic) left join el on m.source=el.source group by 1,2),
h as (select *, {d('negatives::double/items')} negative_share, case when recent+prior>=3 then {d('(recent+0.5::double)/(prior+0.5::double)', 3)} end momentum, cast(least(3,ceil(log2(items+1))) as int) volume_score,
 cast((negatives::double/items>=0.2)::int+(negatives::double/items>=0.4)::int+(negatives::double/items>=0.6)::int as int) negative_score from g),
i as (select *, cast(coalesce((momentum>=1.05)::int+(momentum>=1.3)::int+(momentum>=2)::int,0) as int) momentum_score, cast(least(3,breadth) as int) breadth_score from h)
select *, cast(volume_score+negative_score+momentum_score+breadth_score as int) total, case when volume_score+negative_score+momentum_score+breadth_score>=9 then 'high' when volume_score+negative_score+momentum_score+breadth_score>=5 then 'medium' else 'low' end "label" from i""")
def insight_priority(spark, sf):
    return I.priorities(members(spark, sf), ["game_id", "topic"], M.source_states(load(spark, sf, "runs")).filter(F.col("status").isin("collected", "partial")))


@query("""select identity_key, arg_max(ingest_seq, ingest_seq) ingest_seq, arg_max(relevance_label, ingest_seq) relevance_label from evidence group by 1""")
def dedup_keep_last(spark, sf):
    return S.keep_last(load(spark, sf, "evidence").select("identity_key", "ingest_seq", "relevance_label"), ["identity_key"], "ingest_seq")


# --- telemetry --------------------------------------------------------------------------------------------------------------------
@query(f"""with u as (select o_custkey as "user", cast(min(o_orderdate) as date) signup, c_mktsegment segment from orders join customer on o_custkey=c_custkey group by 1,3 having cast(min(o_orderdate) as date) <= (select cast(max(o_orderdate) as date) from orders) - 30),
a as (select distinct o_custkey as "user", cast(o_orderdate as date) "day" from orders),
p as (select u."user", segment, max(case when "day"-signup=1 then 1 else 0 end) d1, max(case when "day"-signup=7 then 1 else 0 end) d7, max(case when "day"-signup=30 then 1 else 0 end) d30 from u left join a on u."user"=a."user" group by 1,2)
select segment, count(*) eligible, cast(sum(d1) as bigint) d1_users, {d('sum(d1)::double/count(*)')} d1_rate, cast(sum(d7) as bigint) d7_users, {d('sum(d7)::double/count(*)')} d7_rate,
 cast(sum(d30) as bigint) d30_users, {d('sum(d30)::double/count(*)')} d30_rate from p group by 1""")
def retention_d1_d7_d30(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    day = F.to_date("o_orderdate")
    first = o.groupBy(F.col("o_custkey").alias("user")).agg(F.min(day).alias("signup"))
    first = Y.mature(first, "signup", o.agg(F.max(day).alias("end")), 30)
    users = first.join(c.select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment")), "user")
    return Y.retention(users, o.select(F.col("o_custkey").alias("user"), day.alias("day")), by=["segment"])


@query(f"""with e as (select c_mktsegment segment, count(*) eligible from customer group by 1),
p as (select c_mktsegment segment, count(distinct o_custkey) payers, count(*) transactions, sum(o_totalprice) revenue from orders join customer on o_custkey=c_custkey where o_orderstatus='F' group by 1)
select segment, eligible, coalesce(payers,0) payers, coalesce(transactions,0) transactions, cast(round(cast(coalesce(revenue,0) as decimal(18,6)),2) as double) revenue, {d('coalesce(payers,0)::double/eligible')} conversion,
 {d('coalesce(revenue,0)/eligible', 2)} arpu, case when payers>0 then {d('revenue/payers', 2)} end arppu from e left join p using(segment)""")
def monetisation_cohort(spark, sf):
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    pay = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("amount"))
    return Y.monetisation(users, pay, ["segment"])


@query(f"""with p as (select user_id, max((event_type='purchase')::int) bought, max((event_type='error')::int) failed, max((event_type='click' and value>30)::int) outcome from events group by 1)
select bought, failed, count(*) users, cast(sum(outcome) as bigint) with_outcome, {d('sum(outcome)::double/count(*)')} outcome_rate from p group by 1,2""")
def engagement_flags(spark, sf):
    return Y.engagement(load(spark, sf, "events"), "user_id", {"bought": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"}, (F.col("event_type") == "click") & (F.col("value") > 30))


@query(f"""select case when ts<timestamp '2024-01-16' then 'before' else 'after' end period, cast(user_id%3 as int) platform, count(*) sessions, cast(sum((event_type='error')::int) as bigint) failures,
 {d("sum((event_type='error')::int)::double/count(*)")} failure_rate, {d('avg(value)', 2)} mean_value, count(distinct user_id) users from events group by 1,2""")
def segmentation(spark, sf):
    period = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "before").otherwise("after").alias("period")
    return Y.segmentation(load(spark, sf, "events"), [period, (F.col("user_id") % 3).cast("int").alias("platform")], F.col("event_type") == "error", "value", "user_id")


@query(f"""with p as (select user_id, max((event_type='view')::int) a, max((event_type='purchase')::int) b from events group by 1 having max((event_type='view')::int)=1)
select count(*) participants, coalesce(cast(sum(b) as bigint),0) buyers, {d('coalesce(sum(b)::double/nullif(count(*),0),0)', 5)} conversion from p""")
def funnel_conversion(spark, sf):
    return Y.funnel(load(spark, sf, "events"), "user_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query(VOICES + f"""select prim topic, count(*) n, cast(sum((sentiment='negative')::int) as bigint) negative, {d('avg((sentiment=' + chr(39) + 'positive' + chr(39) + ')::int::double)')} positive_share,
 {d('count(*)::double/sum(count(*)) over()')} as "share" from voices group by 1""")
def feedback_topic_summary(spark, sf):
    v = voices(spark, sf).groupBy(F.col("primary").alias("topic")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("sentiment") == "negative", 1).otherwise(0)).alias("negative"), T.rnd(F.avg((F.col("sentiment") == "positive").cast("double")), 4).alias("positive_share")
    )
    from pyspark.sql import Window

    return v.withColumn("share", T.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))  # a few topics


# --- text -------------------------------------------------------------------------------------------------------------------------
@query(f"select doc_id, len(list_filter({words('text')}, lambda t: t in ('guild','server'))) hits from documents")
def term_count_boundary(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.term_hits(T.ascii_tokens(F.col("text")), ["guild", "server"]).cast("bigint").alias("hits"))


@query("select doc_id, (length(coalesce(text,''))-length(replace(coalesce(text,''),'frames','')))//6 hits from documents")
def term_count_substring(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.substring_count(F.col("text"), "frames").alias("hits"))


_low = "lower(coalesce(text,''))"
_sub = lambda terms: "+".join(f"(length({_low})-length(replace({_low},'{t}','')))//{len(t)}" for t in terms)


@query(f"with x as (select doc_id, {_sub(L.POSITIVE)} lex_pos, {_sub(L.NEGATIVE)} lex_neg from documents) select *, case when lex_pos+lex_neg>0 then {d('(lex_pos-lex_neg)::double/(lex_pos+lex_neg)')} else 0.0::double end lex_score from x")
def lexical_sentiment(spark, sf):
    return A.lexical_sentiment(load(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(VOICES + """select ingest_seq, prim, hits, array_to_string(secondary,',') secondary, sentiment, "position", "method" from voices""")
def multi_label_topics(spark, sf):
    return voices(spark, sf).select("ingest_seq", F.col("primary").alias("prim"), F.col("hits").cast("bigint").alias("hits"), F.array_join("secondary", ",").alias("secondary"), "sentiment", "position", "method")


@query(VOICES + f"select ingest_seq, case when prim='unknown' then 0.35::double else {d('least(0.95,0.55+0.08*hits)', 2)} end confidence, prim='unknown' or sentiment='unknown' needs_review from voices")
def annotation_confidence(spark, sf):
    return A.confidence(voices(spark, sf)).select("ingest_seq", "confidence", "needs_review")


@query(f"select doc_id, array_to_string({requests_sql('text')},' | ') requests from documents")
def explicit_requests(spark, sf):
    return A.requests(load(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("requests", " | ").alias("requests"))


@query(f"""with t as (select doc_id, {words('text')} toks from documents) select doc_id, concat_ws(',', {','.join(f"case when len(list_filter(toks, lambda t: t in ({quoted(v)})))>0 then '{k}' end" for k, v in sorted(L.BEHAVIOURS.items()))}) behaviours from t""")
def behaviour_signals(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", T.ascii_tokens(F.col("text")).alias("tokens"))
    return A.behaviours(t).select("doc_id", F.array_join("behaviours", ",").alias("behaviours"))


@query(VOICES + f"""select ingest_seq, case when sentiment in ('negative','mixed') then concat_ws(',', {','.join(f"case when len(list_filter(toks, lambda t: t in ({quoted(v)})))>0 then '{k}' end" for k, v in sorted(L.PAINS.items()))}) else '' end pains,
 case when sentiment in ('negative','mixed') then case prim {' '.join(f"when '{k}' then '{v}'" for k, v in L.NEEDS.items())} end end need from voices""")
def pain_points(spark, sf):
    return A.pains(voices(spark, sf)).select("ingest_seq", F.array_join("pains", ",").alias("pains"), "need")


@query("select doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) fingerprint from documents where regexp_full_match(text, '[\\x00-\\x7F]*')")
def content_fingerprint(spark, sf):
    return load(spark, sf, "documents").filter(F.col("text").rlike(r"\A[\x00-\x7F]*\z")).select("doc_id", T.content_fingerprint(F.col("text")).alias("fingerprint"))


def content_fingerprint_all(spark, sf):
    """Fingerprints of all documents, null for null text. SQL has no compatibility form or full case folding, so no oracle."""
    return load(spark, sf, "documents").select("doc_id", T.content_fingerprint(F.col("text")).alias("fingerprint"))


WITHOUT_ORACLE = {"content_fingerprint_all": content_fingerprint_all}


@query("select o_orderkey, concat('ord_', substr(sha256(concat_ws(':', cast(o_custkey as varchar), o_orderpriority)),1,20)) id from orders")
def stable_ids(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", T.stable_id("ord_", F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("id"))


@query("""select doc_id, regexp_replace(lower(source),'[^a-z0-9]+','-','g') slug, case when length(trim(regexp_replace(title,'[ \\t\\n\\x0B\\f\\r]+',' ','g')))>20 then concat(substr(replace(trim(regexp_replace(title,'[ \\t\\n\\x0B\\f\\r]+',' ','g')),'|','\\|'),1,19),'…') else replace(trim(regexp_replace(title,'[ \\t\\n\\x0B\\f\\r]+',' ','g')),'|','\\|') end cell,
 coalesce(regexp_matches(title,'[㐀-鿿]'),false) cjk from documents""")
def text_functions(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.slug(F.col("source")).alias("slug"), T.cell(F.col("title"), 20).alias("cell"), T.has_cjk(F.col("title")).alias("cjk"))


@query("""select event_id, cast(json_extract_string(props,'$.k') as bigint) k, case when lower(trim(event_type)) in ('','nan','none','null','<na>') then null else trim(event_type) end kind from events""")
def json_props(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), T.nullify(F.col("event_type")).alias("kind"))


@query("""select p_partkey, array_to_string(regexp_extract_all(p_name,'[A-Za-z]+|\\d+'),',') tokens, case when p_size%3=0 then null when p_size%3=1 then true else false end flag from part""")
def tokens_extract(spark, sf):
    flag = T.lenient_bool(F.when(F.col("p_size") % 3 == 0, "maybe").when(F.col("p_size") % 3 == 1, "Yes").otherwise("0"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(F.regexp_extract_all("p_name", F.lit(r"[A-Za-z]+|\d+"), F.lit(0)), ",").alias("tokens"), flag.alias("flag"))


@query("select language, count(*) n from bilibili group by 1")
def language_counts(spark, sf):
    return load(spark, sf, "bilibili").groupBy("language").agg(F.count("*").alias("n"))


# --- store ------------------------------------------------------------------------------------------------------------------------
@query("""select access_scope, content_fingerprint, count(*) as "rows", count(distinct identity_key) identities, count(distinct source) sources from evidence where content_fingerprint is not null group by 1,2 having count(distinct identity_key)>1""")
def cross_posts(spark, sf):
    return U.cross_posts(load(spark, sf, "evidence"))


@query("""with b as (select identity_key, arg_max(evidence_id,ingest_seq) evidence_id, arg_max(game_id,ingest_seq) game_id, arg_max(relevance_label,ingest_seq) relevance_label, max(ingest_seq) s from evidence where run_id < (select max(run_id) from runs) group by 1),
n as (select identity_key, arg_max(evidence_id,ingest_seq) evidence_id, arg_max(game_id,ingest_seq) game_id, arg_max(relevance_label,ingest_seq) relevance_label, max(ingest_seq) s from evidence where run_id >= (select max(run_id) from runs) group by 1)
select identity_key, coalesce(b.evidence_id,n.evidence_id) evidence_id, coalesce(b.game_id,n.game_id) game_id, coalesce(n.relevance_label,b.relevance_label) relevance_label, coalesce(n.s,b.s) ingest_seq from b full join n using(identity_key)""")
def upsert_merge(spark, sf):
    """All runs but the last as base, the last merged into it."""
    last = F.broadcast(load(spark, sf, "runs").agg(F.max("run_id").alias("last")))  # one row
    e = load(spark, sf, "evidence").join(last, how="cross")
    cols = ["identity_key", "evidence_id", "game_id", "relevance_label", "ingest_seq"]
    base = S.keep_last(e.filter("run_id < last").select(*cols), ["identity_key"], "ingest_seq")
    return U.upsert(base, e.filter("run_id >= last").select(*cols)).select(*cols)


@query("""with b as (select * from evidence where run_id <> (select max(run_id) from runs)), n as (select identity_key, count(*) c from evidence where run_id = (select max(run_id) from runs) group by 1)
select cast(sum((k.identity_key is null)::int) as bigint) inserted, cast(sum((k.identity_key is not null)::int) as bigint) updated, cast(sum(c-1) as bigint) repeated from n left join (select distinct identity_key from b) k using(identity_key)""")
def upsert_counters(spark, sf):
    e = load(spark, sf, "evidence")
    last = F.broadcast(load(spark, sf, "runs").agg(F.max("run_id").alias("last")))  # one row
    e = e.join(last, how="cross")
    return U.upsert_counts(e.filter("run_id != last"), e.filter("run_id = last"))


@query("""with n as (select identity_key, arg_max(game_id,ingest_seq) game_id, max(ingest_seq) ingest_seq from evidence where source='steam' group by 1)
select identity_key, game_id, ingest_seq from evidence where game_id not in (select game_id from n) union all select * from n""")
def replace_partition(spark, sf):
    e = load(spark, sf, "evidence").select("identity_key", "game_id", "ingest_seq", "source")
    return U.replace_partition(e.drop("source"), e.filter("source = 'steam'").drop("source"), "game_id", ["identity_key"], "ingest_seq")


@query("""with l as (select evidence_id, count(*) links, array_to_string(list_sort(list(distinct query_id)),',') query_ids, array_to_string(list_sort(list_distinct(flatten(list(alias_ids)))),',') alias_ids from evidence_query_links group by 1)
select e.evidence_id, coalesce(links,0) links, coalesce(query_ids,'') query_ids, coalesce(alias_ids,'') alias_ids from (select distinct evidence_id from evidence) e left join l using(evidence_id)""")
def query_links_nest(spark, sf):
    return U.nest_links(load(spark, sf, "evidence"), load(spark, sf, "evidence_query_links"))


@query("""select 'evidence without run' as "rule", count(*) as "rows", count(distinct run_id) "keys" from evidence where run_id is not null and run_id not in (select run_id from runs)
union all select 'evidence without game', count(*), count(distinct game_id) from evidence where game_id is not null and game_id not in (select game_id from games)
union all select 'link without evidence', count(*), count(distinct evidence_id) from evidence_query_links where evidence_id not in (select evidence_id from evidence)
union all select 'comment without parent', count(*), count(distinct parent_evidence_id) from bilibili where parent_evidence_id is not null and parent_evidence_id not in (select evidence_id from bilibili)""")
def integrity_orphans(spark, sf):
    e, b = load(spark, sf, "evidence"), load(spark, sf, "bilibili")
    return (
        U.orphans(e, load(spark, sf, "runs"), "run_id", "evidence without run")
        .unionByName(U.orphans(e, load(spark, sf, "games"), "game_id", "evidence without game"))
        .unionByName(U.orphans(load(spark, sf, "evidence_query_links"), e, "evidence_id", "link without evidence"))
        .unionByName(U.orphans(b.select(F.col("parent_evidence_id").alias("evidence_id")), b, "evidence_id", "comment without parent"))
    )


@query("""select 'private needs dataset' as "rule", cast(coalesce(sum((access_scope='private' and dataset_id='')::int),0) as bigint) broken from evidence
union all select 'public has no dataset', cast(coalesce(sum((access_scope='public' and dataset_id<>'')::int),0) as bigint) from evidence
union all select 'identity matches', cast(coalesce(sum((identity_key<>sha256(concat_ws('|',access_scope,case when dataset_id='' then 'public' else dataset_id end,source,source_content_id)))::int),0) as bigint) from evidence""")
def contract_violations(spark, sf):
    e = load(spark, sf, "evidence").withColumn("expected", U.identity_key())
    return U.violations(e, {"private needs dataset": "access_scope <> 'private' OR dataset_id <> ''", "public has no dataset": "access_scope <> 'public' OR dataset_id = ''", "identity matches": "identity_key = expected"})


# --- relevance --------------------------------------------------------------------------------------------------------------------
_TITLES, _SAFE, _SCOPED, _RIVALS = ["moon shards", "石像守卫"], ["paper cranes", "纸鹤"], ["guild raid", "公会副本"], ["salt candles", "盐烛"]


def labelled(spark, sf):
    d_ = load(spark, sf, "documents").select("doc_id", "text", "source")
    return R.relevance(d_, "text", _TITLES, _SAFE, _SCOPED, _RIVALS, F.col("source") == "lanternpost_forum")


def _contains(phrases: list[str]) -> str:
    one = lambda p: f"contains(regexp_replace(norm,'[ ]+','','g'),'{p}')" if any("㐀" <= c <= "鿿" for c in p) else f"contains(concat(' ',norm,' '),' {p} ')"
    return "(" + " or ".join(map(one, phrases)) + ")"


_terms_sql = f"len(list_intersect({words('norm')}, [{quoted(L.GAME_TERMS)}]))"
RELEVANCE = f"""
with n as (select doc_id, source, trim(regexp_replace(lower(coalesce(text,'')),'[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+',' ','g'),' ') norm from documents),
h as (select *, {_contains(_TITLES)} t, {_contains(_SAFE)} a, {_contains(_SCOPED)} s, {_contains(_RIVALS)} r, {_terms_sql} k from n),
c as (select *, {d("greatest(0.0,least(1.0,(case when t then 0.78 else 0 end)+(case when a then 0.55 when s then 0.2 else 0 end)+least(k*0.45,0.675)+(case when (a or s) and k>=2 then 0.15 else 0 end)+(case when source='lanternpost_forum' then 0.05 else 0 end)-(case when r then 0.85 else 0 end)))")} score from h),
rel as (select *, case when r and score<0.7 then 'irrelevant' when score>=0.7 and not (s and not a and not t and k=0) then 'relevant' when score>=0.25 or a or s or t then 'ambiguous' else 'irrelevant' end as label from c)
"""


@query(RELEVANCE + "select doc_id, score, label from rel")
def relevance_labels(spark, sf):
    return labelled(spark, sf).select("doc_id", "score", "label")


@query(RELEVANCE + "select doc_id, source, score, k as terms from rel where label='ambiguous'")
def review_queue(spark, sf):
    return labelled(spark, sf).filter("label = 'ambiguous'").select("doc_id", "source", "score", F.col("terms").cast("bigint").alias("terms"))


@query(f"""with x as (select (relevance_label='relevant') p, (relevance_score>=0.5) t from bilibili where relevance_score is not null), g as (select coalesce(sum((p and t)::int),0)::bigint tp, coalesce(sum((p and not t)::int),0)::bigint fp, coalesce(sum((not p and t)::int),0)::bigint fn from x)
select *, {d('coalesce(tp::double/nullif(tp+fp,0),0)')} "precision", {d('coalesce(tp::double/nullif(tp+fn,0),0)')} recall from g""")
def precision_recall(spark, sf):
    b = load(spark, sf, "bilibili").filter("relevance_score is not null")
    return R.precision_recall(b.withColumn("truth", F.when(F.col("relevance_score") >= 0.5, "relevant").otherwise("other")), "relevance_label", "truth")


_GAME_WORDS, _ABSENT = ["guild raid", "公会副本", "boss", "quest"], ["salt candles", "盐烛"]


def entities(spark, sf):
    """The games as entities, their franchises as scoped aliases and the first words of their titles as safe ones."""
    g = load(spark, sf, "games")
    e = g.select("game_id", F.array_compact(F.concat(F.array("canonical_title", "original_title"), F.coalesce(F.map_values("localized_titles"), F.array().cast("array<string>")))).alias("titles"), F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("developers", "publishers")]).alias("companies"), "external_ids")
    alias = lambda text, name, safe: g.select(F.concat(F.lit(name), "game_id").alias("alias_id"), "game_id", text.alias("text"), F.lit("low" if safe else "high").alias("ambiguity"), F.lit("validated" if safe else "scoped_only").alias("status"), F.lit(True).alias("search_enabled"), F.lit(safe).alias("standalone_safe"))
    return R.entity_table(e, alias(F.col("franchise"), "f_", False).unionByName(alias(F.split("canonical_title", " ")[0], "w_", True)).filter("text is not null"))


def word_form(x: str) -> str:
    """SQL of text.word_form, as far as characters with a form of several characters do not matter."""
    return f"trim(regexp_replace(lower(replace(nfc_normalize(translate(coalesce({x},''),'{_FROM}','{_TO}')),'ß','ss')),'[^\\p{{L}}\\p{{N}}_]+',' ','g'))"


_in = lambda p, x="norm": f"({p}<>'' and case when regexp_matches({p},'[㐀-鿿]') then contains(replace({x},' ',''),replace({p},' ','')) else contains(' '||{x}||' ',' '||{p}||' ') end)"
_count_in = lambda words_: "(" + "+".join(f"{_in(quoted([w]))}::int" for w in words_) + ")"


@query(f"""with t as (select game_id, unnest(list_concat([canonical_title, original_title], coalesce(map_values(localized_titles),[]))) x from games), tt as (select game_id, list_distinct(list({word_form('x')})) titles from t where x is not null group by 1),
c as (select game_id, unnest(list_concat(coalesce(developers,[]), coalesce(publishers,[]))) x from games), cc as (select game_id, list_distinct(list({word_form('x')})) companies from c group by 1),
a as (select game_id, 'f_'||game_id alias_id, {word_form('franchise')} w, false safe from games where franchise is not null union all select game_id, 'w_'||game_id, {word_form("split_part(canonical_title,' ',1)")}, true from games where canonical_title is not null),
d as (select doc_id, d.game_id, g.game_id known, {word_form("concat_ws(' ',title,text)")} norm, coalesce(titles,[]) titles, coalesce(companies,[]) companies from documents d left join games g using(game_id) left join tt using(game_id) left join cc using(game_id)),
al as (select doc_id, list_sort(list(alias_id)) ids, bool_or(safe) safe_hit from d join a on d.game_id=a.game_id where {_in('w')} and not list_contains(titles, w) group by 1),
h as (select d.doc_id, d.game_id, known, len(list_filter(titles, lambda p: {_in('p')}))>0 t, len(list_filter(companies, lambda p: {_in('p')}))>0 c, coalesce(ids,[]) ids, coalesce(safe_hit,false) s, {_count_in(_GAME_WORDS)} k, {_count_in(R.CONTEXT_CUES)} q, {_count_in(_ABSENT)} r from d left join al using(doc_id)),
e as (select *, len(ids)>0 al, case when known is null then 0.0::double else {d("greatest(0.0,least(1.0,(case when t then 0.78 else 0 end)+(case when s then 0.55 when len(ids)>0 then 0.2 else 0 end)+(case when c then 0.3 else 0 end)+least(k*0.45,0.675)+(case when len(ids)>0 and q>=2 then 0.15 else 0 end)-(case when r>0 then 0.85 else 0 end)))")} end score from h),
u as (select *, al and not s and not (t or c or k>0) un from e)
select doc_id, game_id, score, case when known is null or (r>0 and score<0.7) then 'irrelevant' when score>=0.7 and not un then 'relevant' when score>=0.25 or al or t then 'ambiguous' else 'irrelevant' end "label", array_to_string(ids,',') alias_ids,
 case when known is null then 'game_id_mismatch' else concat_ws(',', case when t then 'official_title_match' end, case when s then 'safe_alias_match' end, case when al and not s then 'scoped_alias_match' end, case when c then 'developer_publisher_match' end, case when k>0 then 'game_term_match' end, case when r>0 then 'competing_entity_match' end, case when un then 'ambiguous_alias_only' end) end signals from u""")
def relevance_by_entity(spark, sf):
    """Documents against the game they name, with titles, aliases and companies as a joined table."""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "game_id", "source", "title", "text", F.lit(None).cast("map<string,string>").alias("native"), F.lit(None).cast("string").alias("query_game_id"))
    got = R.relevance_to_entity(rows, entities(spark, sf), _GAME_WORDS, _ABSENT)
    return got.select(F.col("id").alias("doc_id"), "game_id", "score", "label", F.array_join("alias_ids", ",").alias("alias_ids"), F.array_join("signals", ",").alias("signals"))


# --- insights ---------------------------------------------------------------------------------------------------------------------
_STATUS = [("bilibili", "collected", None), ("steam", "partial", 10), ("mastodon", "unavailable", 0)]


@query("""with e as (select source, count(*) observed, sum((relevance_label='relevant')::int) relevant, sum((relevance_label='ambiguous')::int) ambiguous, sum((relevance_label='irrelevant')::int) irrelevant from evidence group by 1),
s(source,status,retrieved) as (values ('bilibili','collected',null),('steam','partial',10),('mastodon','unavailable',0))
select source, coalesce(status,'collected') status, cast(coalesce(retrieved,observed) as bigint) retrieved, coalesce(observed,0) observed, cast(coalesce(relevant,0) as bigint) relevant, cast(coalesce(ambiguous,0) as bigint) ambiguous, cast(coalesce(irrelevant,0) as bigint) irrelevant from e full join s using(source)""")
def coverage_full_outer(spark, sf):
    status = spark.createDataFrame(_STATUS, "source string, status string, retrieved long")
    return I.coverage(load(spark, sf, "evidence").select("source", F.col("relevance_label").alias("label")), status)


@query(VOICES + "select source, \"position\", \"method\", prim topic, count(*) n, min(epoch_us(published_at)) first_us, max(epoch_us(published_at)) last_us from voices group by 1,2,3,4")
def sample_scope(spark, sf):
    us = F.unix_micros("published_at")
    return voices(spark, sf).groupBy("source", "position", "method", F.col("primary").alias("topic")).agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def positions(spark, sf):
    return members(spark, sf).select("game_id", "topic", "source", "position", "evidence_id", "ingest_seq")


@query(MEMBERS + f""", per as (select game_id, topic, source, count(*) items, sum(("position"='positive')::int) p, sum(("position"='negative')::int) n, sum(("position"='mixed')::int) m from mem group by 1,2,3),
ord as (select *, n::double/items sh, row_number() over(partition by game_id, topic order by n::double/items desc, source) hi, row_number() over(partition by game_id, topic order by n::double/items, source) lo from per),
g as (select game_id, topic, sum(items)::bigint items, count(*) sources, sum(p)::bigint p, sum(n)::bigint n, sum(m)::bigint m, count(case when p+n>0 then 1 end) ps, count(case when m>0 then 1 end) ms,
 max(case when hi=1 then sh end)-max(case when lo=1 then sh end) gap, max(case when hi=1 then items end) hi_n, max(case when lo=1 then items end) lo_n from ord group by 1,2),
r as (select *, row_number() over(partition by game_id order by items desc, topic) "rank" from g qualify row_number() over(partition by game_id order by items desc, topic)<=12),
u as (select game_id, topic, "rank", 'research_gap' kind, items supports, 0::bigint challenges, sources ks from r where topic='unknown'
 union all select game_id, topic, "rank", 'praise', p, n, ps from r where topic<>'unknown' and p>0 union all select game_id, topic, "rank", 'complaint', n, p, ps from r where topic<>'unknown' and n>0
 union all select game_id, topic, "rank", 'controversy', p, n, ps from r where topic<>'unknown' and p>0 and n>0 union all select game_id, topic, "rank", 'research_gap', m, 0, ms from r where topic<>'unknown' and m>0 and not (p>0 and n>0)
 union all select game_id, topic, "rank", 'difference', hi_n, lo_n, 2 from r where topic<>'unknown' and sources>=2 and gap>=0.3)
select game_id, topic, cast("rank" as int) "rank", kind, cast(supports as bigint) supports, cast(challenges as bigint) challenges, {d('least(0.95,0.45+0.08*least(5,supports+challenges)+0.05*least(2,ks))', 3)} confidence
 from u qualify kind='research_gap' or row_number() over(partition by game_id, kind order by "rank")<=12""")
def insights_union(spark, sf):
    return I.insights(positions(spark, sf))


@query(MEMBERS + f""", g as (select topic, source, count(*) n, {d('sum(("position"=' + chr(39) + 'negative' + chr(39) + ')::int)::double/count(*)')} as sh from mem group by 1,2),
r as (select topic, source, sh, row_number() over(partition by topic order by sh desc, source) hi, row_number() over(partition by topic order by sh, source) lo, count(*) over(partition by topic) sources from g)
select a.topic, a.sources, a.source highest, b.source lowest, {d('a.sh-b.sh')} gap from r a join r b on a.topic=b.topic and a.hi=1 and b.lo=1 where a.sources>=2 and {d('a.sh-b.sh')}>=0.3""")
def source_gap_difference(spark, sf):
    return I.source_gap(positions(spark, sf))


@query(MEMBERS + f""", req as (select game_id, source, evidence_id, 'explicit_request' origin, unnest({requests_sql('txt')}) as "name" from corp),
nee as (select game_id, source, evidence_id, 'inferred_need' origin, case prim """ + " ".join(f"when '{k}' then '{v}'" for k, v in L.NEEDS.items()) + """ end as "name" from corp where sentiment in ('negative','mixed')),
g as (select game_id, origin, "name", count(*) mentions, count(distinct evidence_id) items, count(distinct source) sources from (select * from req union all select * from nee where "name" is not null) group by 1,2,3)
select game_id, origin, "name", mentions, items, cast(row_number() over(partition by game_id, origin order by mentions desc, "name") as int) "rank", """ + d("least(0.95,0.45+0.08*least(5,items)+0.05*least(2,sources))", 3) + """ confidence
 from g qualify row_number() over(partition by game_id, origin order by mentions desc, "name")<=12""")
def opportunity_groups(spark, sf):
    """Explicit requests and the needs inferred from complaints, the first twelve of each game."""
    c = A.pains(A.requests(I.corpus(voices(spark, sf)), "text"))
    c = c.withColumn("needs", F.array_compact(F.array("need")))
    return I.opportunities(c, "requests", "explicit_request").unionByName(I.opportunities(c, "needs", "inferred_need"))


@query(MEMBERS + """, e as (select topic, evidence_id, max(("position"='positive')::int) p, max(("position"='negative')::int) n from mem where topic<>'unknown' group by 1,2),
g as (select topic, cast(sum(p) as bigint) pro, cast(sum(n) as bigint) con, cast(sum(p*n) as bigint) shared from e group by 1) select *, shared=0 distinguishable from g where pro>=2 and con>=2""")
def controversy_sides(spark, sf):
    return M.controversies(positions(spark, sf))


# --- plans, aliases, entities -----------------------------------------------------------------------------------------------------
@query("""with m as (select r_name region, n_name nation, n_nationkey, cast(row_number() over(partition by r_name order by n_nationkey) as int) slot from region cross join nation) select region, nation, slot from m where slot<=7""")
def query_matrix(spark, sf):
    n = load(spark, sf, "nation")
    return P.query_matrix(load(spark, sf, "region").select(F.col("r_name").alias("region")), n.select(F.col("n_name").alias("nation"), "n_nationkey"), ["region"], [F.col("n_nationkey")], 7).select("region", "nation", "slot")


@query("""with a as (select *, row_number() over(partition by p_brand, p_type order by p_partkey) f from part), b as (select *, cast(row_number() over(partition by p_brand order by (f>1)::int, p_partkey) as int) slot from a) select p_brand, p_partkey, slot from b where slot<=5""")
def plan_selection(spark, sf):
    return P.select_plans(load(spark, sf, "part").select("p_brand", "p_type", "p_partkey"), "p_brand", "p_type", "p_partkey", 5).select("p_brand", "p_partkey", "slot")


def observations(spark, sf):
    p = load(spark, sf, "part")
    return p.select(
        T.name_key(F.split("p_name", " ")[0]).alias("key"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("text"), (F.col("p_size") % 4 + 1).alias("type_rank"), (F.col("p_size") % 3 + 1).alias("ambiguity_rank"),
        F.col("p_brand").alias("value"), (F.col("p_size") / 50.0).alias("confidence"), (F.col("p_size") > 40).alias("flag"),
    )


MERGED = """with o as (select regexp_replace(lower(split_part(p_name,' ',1)),'[^a-z0-9_]+','','g') as "key", p_partkey seq, p_name as txt, p_size%4+1 tr, p_size%3+1 ar, p_brand v, p_size/50.0::double cf, p_size>40 fl from part),
m as (select "key", count(*) observations, arg_min(txt,seq) as "text", min(tr) type_rank, max(ar) ambiguity_rank, array_to_string(list_sort(list(distinct v)),',') as "values", max(cf) confidence, bool_or(fl) any_flag from o group by 1)"""


@query(MERGED + ' select * from m')
def alias_merge(spark, sf):
    return P.merge_observations(observations(spark, sf), "key", "seq")


@query(MERGED + """ select "key", case when observations<1 then 'rejected' when ambiguity_rank>=3 then case when confidence>=0.6 then 'scoped' else 'rejected' end when ambiguity_rank=2 then 'scoped' when type_rank>=3 and observations<2 then 'pending' when confidence<0.5 then 'pending' else 'validated' end status from m""")
def alias_validation(spark, sf):
    return P.validate_aliases(P.merge_observations(observations(spark, sf), "key", "seq")).select("key", "status")


@query(f"""with r as (select c_mktsegment, c_name, c_acctbal, lead(c_acctbal) over(partition by c_mktsegment order by c_acctbal desc, c_name) nx, row_number() over(partition by c_mktsegment order by c_acctbal desc, c_name) rn from customer)
select c_mktsegment, c_name best, c_acctbal score, {d('c_acctbal-coalesce(nx,0)', 2)} margin from r where rn=1""")
def top_margin(spark, sf):
    return P.closest_margin(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "c_name").drop("contested").withColumn("margin", T.rnd(F.col("margin"), 2))


@query("""with k as (select distinct c_name, c_nationkey::varchar||':'||(floor(c_acctbal/250))::bigint kk from customer), h as (select kk, min(c_name) head from k group by 1) select distinct head a, c_name b from k join h using(kk) where c_name<>head""")
def entity_links(spark, sf):
    """Customers of one nation and one band of balances as entities that share an external id."""
    c = load(spark, sf, "customer").select("c_name", F.create_map(F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 250).cast("string")).alias("ids"))
    return P.entity_links(c, "c_name", "ids")


# --- facts ------------------------------------------------------------------------------------------------------------------------
def part_facts(spark, sf):
    return K.unpivot(load(spark, sf, "part"), "p_partkey", {"brand": "p_brand", "size": "p_size", "type": "p_type"})


_FACTS = "f as (select cast(p_partkey as varchar) entity, 'brand' fact_type, p_brand as val from part union all select cast(p_partkey as varchar), 'size', cast(p_size as varchar) from part union all select cast(p_partkey as varchar), 'type', p_type from part)"


@query(f"with {_FACTS} select entity, fact_type, val as \"value\", concat('fact_',substr(sha256(concat_ws(':',entity,fact_type,val)),1,20)) fact_id from f where val is not null and trim(val)<>''")
def fact_unpivot(spark, sf):
    return part_facts(spark, sf)


@query("""select cast(l_partkey as varchar) as entity, 'return_flag' fact_type, count(*) facts, count(distinct l_returnflag) as "values" from lineitem group by 1 having count(distinct l_returnflag)>1""")
def fact_conflicts(spark, sf):
    f = load(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("entity"), F.lit("return_flag").alias("fact_type"), F.col("l_returnflag").alias("value"))
    return K.conflicts(f, ["entity", "fact_type"])


@query("select evidence_id, version_context from bilibili where version_context is null or lower(version_context) in ('1.4','7.15')")
def scope_filter(spark, sf):
    return load(spark, sf, "bilibili").filter(K.in_scope(F.col("version_context"), ["1.4", "7.15"])).select("evidence_id", "version_context")


@query(f"with {_FACTS}, h as (select entity, list(distinct fact_type) v from f where fact_type in ('brand','size','price') group by 1) select entity, array_to_string(list_sort(v),',') available, array_to_string(list_sort(list_filter(['brand','size','price'], lambda x: not list_contains(v,x))),',') missing from h")
def fact_readiness(spark, sf):
    return K.readiness(part_facts(spark, sf), ["brand", "size", "price"])


# --- modes ------------------------------------------------------------------------------------------------------------------------
@query(MEMBERS + f""", c as (select game_id as subject, topic dimension, count(*) n, count(distinct source) sources from mem group by 1,2), t as (select subject, sum(n) total from c group by 1), grid as (select subject, total, dimension from t cross join (select distinct dimension from c))
select g.subject, g.dimension, coalesce(n,0) n, {d('100.0*coalesce(n,0)::double/total', 1)} as "share", case when coalesce(n,0)=0 then 'insufficient' when n<3 then 'low' when n>=5 and sources>=2 then 'higher' else 'medium' end confidence from grid g left join c using(subject,dimension)""")
def compare_grid(spark, sf):
    return M.compare_grid(positions(spark, sf).select(F.col("game_id").alias("subject"), F.col("topic").alias("dimension"), "source"))


@query(MEMBERS + """, g as (select topic, sum(("position"='positive')::int) p, sum(("position"='negative')::int) n, count(distinct source) sources from mem group by 1)
select topic, cast(p as bigint) praise, cast(n as bigint) complaints, sources, case when topic in ('economy') and p+n>0 then 'possible_friction' when topic in ('audio','story') and p>0 then 'likely_match' when topic in ('audio','story') and n>0 then 'possible_friction' else 'uncertain' end fit from g""")
def preference_fit(spark, sf):
    return M.preference_fit(positions(spark, sf), wanted=["audio", "story"], avoided=["economy"])


@query(VOICES + f""", w as (select prim topic, cast(count(*) as bigint) total from voices where sentiment in ('negative','mixed') group by 1)
select v.ingest_seq, v.prim topic, coalesce(total,-1) weight, cast(row_number() over(partition by v.prim order by v.hits desc, v.ingest_seq) as int) rank from voices v left join w on v.prim=w.topic where v.sentiment in ('negative','mixed') qualify row_number() over(partition by v.prim order by v.hits desc, v.ingest_seq)<=20""")
def analyst_findings(spark, sf):
    return M.findings(voices(spark, sf), 20)


@query("""select 'intersect' kind, n_nationkey k from nation where n_nationkey in (select c_nationkey from customer) and n_nationkey in (select s_nationkey from supplier)
union all select 'except', n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier) union all select 'union', k from (select s_nationkey k from supplier union select n_regionkey from nation)""")
def set_ops(spark, sf):
    n, c, s = load(spark, sf, "nation"), load(spark, sf, "customer"), load(spark, sf, "supplier")
    a, b, x = n.select(F.col("n_nationkey").alias("k")), c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(a.intersect(b).intersect(x), "intersect").unionByName(tag(a.exceptAll(x.distinct()), "except")).unionByName(tag(x.union(n.select("n_regionkey")).distinct(), "union"))


@query("""with s as (select run_id, unnest(json_keys(source_status)) source, source_status from runs), x as (select run_id, source, json_extract_string(source_status, '$.'||source||'.status') status, cast(json_extract_string(source_status, '$.'||source||'.items_retrieved') as bigint) items from s),
g as (select source, count(*) runs, cast(sum(items) as bigint) items, case when sum(items)>0 and bool_or(status='failed') then 'partial' when bool_and(status='collected') then 'collected' when bool_or(status='partial') then 'partial' when bool_and(status='unavailable') then 'unavailable' else 'failed' end state from x group by 1)
select coalesce(g.source, w.source) source, coalesce(runs,0) runs, coalesce(items,0) items, coalesce(state,'disabled') state from g full join (values ('mastodon'),('steam')) w(source) on g.source=w.source""")
def status_rollup(spark, sf):
    return M.status_rollup(load(spark, sf, "runs"), ["mastodon", "steam"])




# --- rows and corpus --------------------------------------------------------------------------------------------------------------
@query("""select substr(sha256(concat_ws(':',source,source_content_id)),1,20) record_id, source, case when source='steam' then 'store_review' else 'video_comment' end source_type, g.canonical_title game, coalesce(source_metadata.bvid, source) channel,
 evidence_kind content_type, source_content_id, regexp_replace(parent_evidence_id,'^ev_','') parent_id, title, source_url url, language, epoch_us(coalesce(published_at,retrieved_at)) created_us, original_text "text", recommended, rating,
 coalesce(engagement.likes,0)::double engagement_score, reply_count, playtime_hours from bilibili left join games g using(game_id)""")
def voice_rows(spark, sf):
    b = load(spark, sf, "bilibili").join(load(spark, sf, "games").select("game_id", F.col("canonical_title").alias("game_title")), "game_id", "left")
    return V.to_voice_rows(b, F.col("game_title")).withColumn("created_us", F.unix_micros(F.col("created_at").cast("timestamp"))).drop("created_at", "collected_at", "metadata_json")


@query("""with v as (select substr(sha256(concat_ws(':',source,doc_id::varchar)),1,20) record_id, source, doc_kind content_type, 'community_export' source_type, coalesce(game_id,'') game, doc_id::varchar cid, title, url, lang, text from documents where text is not null and trim(text)<>'')
select 'ev_'||record_id evidence_id, concat_ws('_','game',case when trim(regexp_replace(lower(game),'[^a-z0-9]+','-','g'),'-')='' then 'unknown' else substr(trim(regexp_replace(lower(game),'[^a-z0-9]+','-','g'),'-'),1,48) end, substr(sha256(lower(game)),1,8)) game_id,
 case when contains(lower(content_type),'review') then 'review' when contains(lower(content_type),'comment') then 'comment' when contains(lower(content_type),'post') then 'post' when contains(lower(content_type),'video') then 'video' else 'post' end evidence_kind,
 'public' access_scope, source, cid source_content_id, cast(null as varchar) parent_evidence_id, url source_url, case when url is null then source||':'||cid end source_reference, title, text original_text, lang "language", 'run_import' run_id, 'public_endpoint' retrieval_method,
 'pending' relevance_label, case when source='steam' then 'platform_store' else 'public_community' end source_class, sha256(text) content_checksum from v""")
def evidence_rows(spark, sf):
    d_, null = load(spark, sf, "documents").filter("text is not null and trim(text) <> ''"), F.lit(None).cast("string")
    v = d_.select(F.substring(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256), 1, 20).alias("record_id"), "source", F.col("doc_kind").alias("content_type"), F.lit("community_export").alias("source_type"), F.coalesce("game_id", F.lit("")).alias("game"), null.alias("channel"), F.col("doc_id").cast("string").alias("source_content_id"), null.alias("parent_id"), "title", "url", F.col("lang").alias("language"), "text")
    return V.to_evidence(v, "run_import")


@query("""select evidence_id, game_id, source, source_content_id, title, original_text, source_url, query_id, relevance_score, relevance_label, array_to_string(relevance_reasons,'|') relevance_reasons, relevance_method_version, coalesce(len(matched_alias_ids),0) aliases from bilibili where relevance_label='ambiguous'""")
def review_rows(spark, sf):
    q = V.review_queue(load(spark, sf, "bilibili"))
    return q.withColumn("relevance_reasons", F.array_join("relevance_reasons", "|")).withColumn("aliases", F.col("query_provenance.aliases").cast("long")).drop("query_provenance")


@query("""select evidence_id, run_id, case when length(trim(source_metadata.anonymised_author_id))>0 then substr(sha256(source||':'||trim(source_metadata.anonymised_author_id)),1,16) end author_key, 'ev_'||substr(sha256(concat_ws(':',source,source_content_id)),1,20) stable from bilibili""")
def author_keys(spark, sf):
    return V.authors(load(spark, sf, "bilibili"), F.col("source_metadata.anonymised_author_id")).select("evidence_id", "run_id", "author_key", "stable")


@query("""select case when evidence_kind='fact_source' then 'official' else source end source, count(*) items, cast(sum((relevance_label='relevant')::int) as bigint) relevant, cast(sum((relevance_label='ambiguous')::int) as bigint) ambiguous, cast(sum((relevance_label='irrelevant')::int) as bigint) irrelevant,
 count(*)-count(distinct (source, source_content_id)) duplicates from evidence group by 1""")
def source_counts(spark, sf):
    return C.source_counts(load(spark, sf, "evidence"))


@query(f"select access_scope, relevance_label, count(*) items from evidence where evidence_kind in ({quoted(I.COMMUNITY_KINDS)}) group by 1,2")
def label_counts(spark, sf):
    return C.label_counts(load(spark, sf, "evidence"))


@query("""select dataset_id, owner_scope, count(*) as "rows" from evidence where access_scope='private' and (dataset_id, owner_scope) not in (select dataset_id, owner_scope from (select dataset_id, owner_scope, min(ingest_seq) s from evidence where access_scope='private' group by 1,2) where s<1000) group by 1,2""")
def unregistered_datasets(spark, sf):
    """Private rows whose dataset and owner are not registered; registered are those that came first."""
    p = load(spark, sf, "evidence").filter("access_scope = 'private'")
    registered = p.groupBy("dataset_id", "owner_scope").agg(F.min("ingest_seq").alias("s")).filter("s < 1000")
    return C.missing_from(p, registered, ["dataset_id", "owner_scope"])


@query("""with q as (select evidence_id, query_id, min(intent) intent from evidence_query_links group by 1,2) select b.evidence_id, b.run_id, b.query_id, coalesce(intent, 'unlinked:'||retrieval_method, 'unlinked') provenance from bilibili b left join q on b.evidence_id=q.evidence_id and b.query_id=q.query_id""")
def query_provenance(spark, sf):
    return C.with_query(load(spark, sf, "bilibili"), load(spark, sf, "evidence_query_links")).select("evidence_id", "run_id", "query_id", "provenance")


@query("""with i as (select distinct evidence_id id from evidence_query_links union select game_id from games) select id, case when id in (select evidence_id from evidence) then 'community' else 'fact' end layer from i""")
def id_layers(spark, sf):
    ids = load(spark, sf, "evidence_query_links").select(F.col("evidence_id").alias("id")).union(load(spark, sf, "games").select("game_id")).distinct()
    return C.layers(ids, load(spark, sf, "evidence"))


@query(MEMBERS + """select game_id, count(distinct evidence_id) items, array_to_string(list_sort(list(distinct source)),',') sources, min(published_at at time zone 'UTC')::date first_day, max(published_at at time zone 'UTC')::date last_day, 0::bigint extension_topics from mem group by 1""")
def game_coverage(spark, sf):
    return C.game_coverage(members(spark, sf).withColumn("language", F.lit(None).cast("string"))).drop("languages")


_COMPARED = "(select game_id from games order by game_id limit 3)"  # the three games of the comparison, which is its feature


@query(MEMBERS + f""", p as (select topic, game_id, count(*) n, array_to_string(list_sort(list(distinct source)),',') mix, max(published_at) e from mem where game_id in {_COMPARED} group by 1,2),
g as (select topic, count(*) games, min(n) lo, max(n) most, count(distinct mix) mixes, count(e) dated, floor((epoch_us(max(e))-epoch_us(min(e)))/86400000000.0) gap from p group by 1),
h as (select *, concat_ws('; ', case when mixes>1 then 'source mix' end, case when dated=games and gap>180 then 'dates' end, case when most/lo>4 then 'sample sizes' end) r, case when games<3 then 0 else lo end as "least" from g),
k as (select *, case when "least"<3 then 'insufficient_evidence' when r<>'' then 'comparable_with_caution' else 'comparable' end status from h) select topic, games, "least", most, status, case when status='comparable_with_caution' then r else '' end reasons from k""")
def comparison_status(spark, sf):
    games = [r[0] for r in load(spark, sf, "games").select("game_id").orderBy("game_id").limit(3).collect()]
    return C.comparison_status(members(spark, sf), games)


@query("""with f as (select game_id, 'franchise' fact_type from games where franchise is not null and trim(franchise)<>'' union all select game_id, 'genre' from (select game_id, unnest(genres) x from games) where x is not null union all select game_id, 'platform' from (select game_id, unnest(platforms) x from games) where x is not null)
select fact_type, count(distinct game_id) available, count(*) as "values", (select count(distinct game_id) from games) entities, case when count(distinct game_id)=(select count(distinct game_id) from games) then 'comparable' else 'partial' end status from f group by 1""")
def fact_status(spark, sf):
    g = load(spark, sf, "games")
    many = lambda c, name: g.select(F.col("game_id").alias("entity"), F.lit(name).alias("fact_type"), F.explode(c).alias("value"))
    f = g.select(F.col("game_id").alias("entity"), F.lit("franchise").alias("fact_type"), F.col("franchise").alias("value")).unionByName(many("genres", "genre")).unionByName(many("platforms", "platform"))
    return C.fact_status(f.filter("value is not null and trim(value) <> ''"), g.select(F.col("game_id").alias("entity")))


@query("""with r as (select p_brand, p_partkey, row_number() over(partition by p_brand order by p_retailprice desc, p_partkey)-1 rk, p_size from part), t as (select * from r where rk<10),
g as (select p_brand, min(case when p_size>=25 then rk end) rk, sum(case when not p_size>=25 and rk<5 then 1 else 0 end) c, min(case when p_size>=25 then p_partkey end) item from t group by 1)
select p_brand, item, cast(rk as int) "rank", cast(c as bigint) competitors, case when c=0 then 'none' when length(p_brand)<=3 then 'high' else 'medium' end ambiguity from g where rk is not null""")
def result_ranks(spark, sf):
    return C.result_ranks(load(spark, sf, "part"), "p_brand", F.col("p_partkey"), [F.desc("p_retailprice"), F.col("p_partkey")], F.col("p_size") >= 25, F.length("p_brand"))


@query("""select game_id, arg_min(query_id, ingest_seq) filter (query_id is not null) query_id, arg_min(source_url, ingest_seq) filter (source_url is not null) source_url from evidence group by 1""")
def first_values(spark, sf):
    return C.first_values(load(spark, sf, "evidence"), ["game_id"], "ingest_seq", ["query_id", "source_url"])


_HOURS = " ".join(f"when '{k}' then {v}" for k, v in T.HOURS.items())


@query(rf"""with t as (select evidence_id, run_id, lower(coalesce(original_text,'')) t, reply_count from bilibili),
m as (select *, nullif(regexp_extract(t,'(\d+(?:\.\d+)?|半|一个|一|两|二|三|四)\s*(?:个)?小时',1),'') z, nullif(regexp_extract(t,'(\d+)\s*(?:分钟|minutes?|mins?)',1),'') s, nullif(regexp_extract(t,'(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)',1),'') l from t)
select evidence_id, run_id, cast(coalesce(floor(60*coalesce(case z {_HOURS} end, try_cast(z as double))), try_cast(s as bigint), floor(60*try_cast(l as double))) as bigint) "minutes", cast(round(cast(1+ln(1+greatest(0,coalesce(reply_count,0))) as decimal(18,6)),4) as double) "weight" from m""")
def minutes_and_weights(spark, sf):
    b = load(spark, sf, "bilibili")
    return b.select("evidence_id", "run_id", T.minutes(F.col("original_text")).cast("bigint").alias("minutes"), T.rnd(T.weight(F.col("reply_count")), 4).alias("weight"))


def candidate_assessment(spark, sf):
    """Every game against the title of the first one. The similarity of matching blocks has no SQL; tested against difflib."""
    g = load(spark, sf, "games")
    title = g.orderBy("game_id").select("canonical_title").first()[0]
    none = F.array().cast("array<string>")
    titles = F.array_compact(F.concat(F.array("canonical_title", "original_title"), F.coalesce(F.map_values("localized_titles"), none)))
    c = g.select("game_id", F.lit("catalog").alias("provider"), titles.alias("titles"), F.coalesce(F.map_keys("localized_titles"), none).alias("locales"), "developers", "publishers", "platforms", "external_ids")
    return Z.assess(c, title)


WITHOUT_ORACLE["candidate_assessment"] = candidate_assessment


@query("""with r as (select c_nationkey, c_name, c_acctbal/10000 s, lead(c_acctbal/10000) over(partition by c_nationkey order by c_acctbal desc, c_name) nx, row_number() over(partition by c_nationkey order by c_acctbal desc, c_name) rn from customer),
m as (select c_nationkey, c_name best, s, nx, s-coalesce(nx,0) g from r where rn=1) select c_nationkey, best, case when s>=0.7 and not (nx is not null and g<0.12) then 'resolved' when s>=0.45 and nx is not null and g<0.12 then 'needs_choice' else 'unresolved' end status from m""")
def resolution_status(spark, sf):
    c = load(spark, sf, "customer").select("c_nationkey", "c_name", (F.col("c_acctbal") / 10000).alias("s"))
    return P.resolution(P.closest_margin(c, "c_nationkey", "s", "c_name")).select("c_nationkey", "best", "status")


_TEMPLATES = [("steam", "reviews", "en", "{alias} review"), ("bilibili", "reviews", "zh", "{alias} 评测"), ("bilibili", "general", "zh", "{alias}"), ("reddit", "general", "en", "{alias}")]


@query("""with a as (select game_id, 't_'||game_id alias_id, trim(regexp_replace(lower(canonical_title),'[^\\p{L}\\p{N}]+','','g')) k, canonical_title x, cast(null as varchar) l, 1 ty, true safe from games where canonical_title is not null
 union all select game_id, 'f_'||game_id, trim(regexp_replace(lower(franchise),'[^\\p{L}\\p{N}]+','','g')), franchise, 'en', 5, false from games where franchise is not null),
l(lang, fam) as (values ('en','en'),('zh-CN','zh')), c as (select *, row_number() over(partition by game_id, lang, k order by case when safe then 0 else 1 end, ty, k, alias_id) again from a, l where l is null or l=fam),
t(source, intent, f, tpl) as (values ('steam','reviews','en','{alias} review'),('bilibili','reviews','zh','{alias} 评测'),('bilibili','general','zh','{alias}'),('reddit','general','en','{alias}')),
q as (select game_id, alias_id, source, lang, intent, trim(replace(tpl,'{alias}',x)) qt from c join t on fam=f where again=1)
select game_id, alias_id, source, lang as "language", intent, qt query_text, 'query_'||substr(sha256(concat_ws('|','run',source,lang,intent,trim(regexp_replace(lower(qt),'\\s+',' ','g')))),1,20) query_id from q""")
def rendered_queries(spark, sf):
    """Titles and franchises of the games as aliases, rendered into the queries of four templates in two languages."""
    g, none = load(spark, sf, "games"), F.lit(None).cast("string")
    alias = lambda c, name, lang, kind, safe: g.filter(F.col(c).isNotNull()).select("game_id", F.concat(F.lit(name), "game_id").alias("alias_id"), T.alias_key(F.col(c)).alias("key"), F.col(c).alias("text"), lang.alias("language"), F.lit(kind).alias("alias_type"), F.lit("validated" if safe else "scoped_only").alias("status"), F.lit(True).alias("search_enabled"), F.lit(safe).alias("safe"), F.lit(0.9).alias("confidence"))
    a = alias("canonical_title", "t_", none, "official_title", True).unionByName(alias("franchise", "f_", F.lit("en"), "community_nickname", False))
    usable = P.usable_aliases(a, spark.createDataFrame([("en",), ("zh-CN",)], "language string"))
    return P.render_queries(usable, spark.createDataFrame(_TEMPLATES, "source string, intent string, language_family string, template string"), "run")


@query(f"""with y as (select cast(o_orderdate as date) tm, o_orderpriority p, o_orderstatus s from orders), g as (select extract(year from tm)::int "year", p, sum((s<>'P')::int)::bigint as "rows", sum((s='F')::int)::bigint matching from y group by 1,2)
select "year", p priority, "rows", matching, {d('coalesce(matching::double/nullif("rows",0),0)')} "share" from g union all select "year", 'all', cast(sum("rows") as bigint), cast(sum(matching) as bigint), {d('coalesce(sum(matching)::double/nullif(sum("rows"),0),0)')} from g group by 1""")
def subset_share(spark, sf):
    """Finished orders among those not pending by year and priority, and rolled up over the priorities."""
    o = load(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    g = Y.subset_share(o, ["year", "priority"], F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    every = Y.roll_up(g, ["year"], ["rows", "matching"]).select("year", F.lit("all").alias("priority"), "rows", "matching", T.ratio(F.col("matching"), F.col("rows")).alias("share"))
    return g.unionByName(every)


_TRIGGERS = [("competition.ranked", ["Shooter", "Fighting", "Sports"]), ("economy.gacha", ["Gacha", "Role-Playing", "RPG"]), ("world.building", ["Simulation", "Strategy", "Survival"])]


@query("""with g as (select distinct game_id, trim(regexp_replace(lower(t),'[^a-z0-9㐀-鿿]+','_','g'),'_') t from (select game_id, unnest(genres) t from games)), x(topic, t) as (values """ + ",".join(f"('{k}','{t.lower().replace('-', '_')}')" for k, v in _TRIGGERS for t in v) + """) select distinct game_id, topic from g join x using(t)""")
def active_topics(spark, sf):
    g = load(spark, sf, "games").select("game_id", F.col("genres").alias("tags"))
    return P.active_topics(g, spark.createDataFrame(_TRIGGERS, "topic string, tags array<string>"))


@query(MEMBERS + f""", g as (select topic, source, count(*) n, {d('sum(("position"=' + chr(39) + 'negative' + chr(39) + ')::int)::double/count(*)')} as sh from mem group by 1,2),
r as (select topic, source, n, sh, row_number() over(partition by topic order by sh desc, source) hi, row_number() over(partition by topic order by sh, source) lo from g)
select a.topic, a.source highest, b.source lowest, a.n highest_n, b.n lowest_n from r a join r b on a.topic=b.topic and a.hi=1 and b.lo=1 where a.source<>b.source and {d('a.sh-b.sh')}>=0.1 and a.n>=2 and b.n>=2""")
def usable_differences(spark, sf):
    m = positions(spark, sf)
    got = M.usable_difference(I.source_gap(m, 0.1), m.groupBy("topic", "source").agg(F.count("*").alias("n")))
    return got.select("topic", "highest", "lowest", "highest_n", "lowest_n")
