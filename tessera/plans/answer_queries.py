"""Queries over conversations and events: answers, numbers, entities, costs; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import generation as G
from tessera.plans.retrieval_queries import table

PART_ALIASES = [("econ", "econ line"), ("economy", "economy class"), ("standard", "basic grade"), ("small", "small size"), ("large", "large size"), ("promo", "promotion")]


def _texts(spark, d):
    """All texts: documents and turns."""
    a = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    b = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return a.union(b)


def _pairs(spark, d):
    """A user's turn and the assistant's that follows: the answer is held against the question."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"), F.lead("turn").over(w).alias("next_turn"))
    return x.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def entity_mentions(spark, d):
    t = F.col("text")
    rows = [("number", F.array_distinct(G.numbers(t))), ("year", E.years(t)), ("filing", E.filing_types(t)), ("metric", E.metrics(t)), ("company", E.companies(t))]

    def named(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    kinds = F.flatten(F.array(*[named(k, a) for k, a in rows]))
    return _texts(spark, d).select("id", F.explode(kinds).alias("m")).select("id", "m.kind", "m.value")


def entity_sets(spark, d):
    m = entity_mentions(spark, d)
    return m.groupBy("id", "kind").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("entities"))


def year_expand(spark, d):
    spans = table(spark, d, "nation").select(
        "n_nationkey", F.concat(F.lit("from "), (F.col("n_nationkey") + 1995).cast("string"), F.lit("-"), (F.col("n_nationkey") + 1998).cast("string"), F.lit(" and 2021-23")).alias("text")
    )
    return spans.select("n_nationkey", F.array_join(E.years_with_ranges(F.col("text")), ",").alias("years"))


def query_type(spark, d):
    q = E.query_type(F.col("text"))
    names = ("numeric", "comparing", "explaining", "general")
    return table(spark, d, "conversations").select("conv_id", "turn", *[q[i].alias(n) for i, n in enumerate(names)])


def metric_canonical(spark, d):
    return table(spark, d, "part").select("p_partkey", E.canonical_first(F.col("p_type"), PART_ALIASES).alias("canonical"))


def lexicon_longest(spark, d):
    """The canonical name of the longest pattern in each part's type."""
    lexicon = spark.createDataFrame(PART_ALIASES, "pattern string, canonical string")
    t = F.lower("p_type")
    found = table(spark, d, "part").join(F.broadcast(lexicon), F.contains(t, F.col("pattern")))
    return found.groupBy("p_partkey").agg(F.max_by("canonical", F.struct(F.length("pattern"), "pattern")).alias("canonical"))


def answer_eval(spark, d):
    cols = ("answered", "exact", "relaxed", "f1", "number_match", "tolerance", "unit_match")
    return G.evaluate_answers(_pairs(spark, d), "answer", "question").select("conv_id", "turn", *cols)


def answer_eval_summary(spark, d):
    e = answer_eval(spark, d)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return e.agg(F.count(F.lit(1)).alias("pairs"), F.sum("answered").alias("answered"), mean("relaxed"), mean("f1"), mean("number_match"), mean("unit_match"))


def verify_numbers(spark, d):
    return G.verify_numbers(_pairs(spark, d), "answer", "question").select("conv_id", "turn", "unsupported", "year_ok", "consistent")


def error_taxonomy(spark, d):
    p = _pairs(spark, d)
    overlap = F.size(F.array_intersect(G.token_set(G.normalize_answer(F.col("answer"))), G.token_set(G.normalize_answer(F.col("question")))))
    kind = G.error_type("question", "answer", "question", F.length("answer"), overlap)
    return p.groupBy(kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def token_budget(spark, d):
    """Turns of a conversation that fit in 60 tokens, longest conversations included whole."""
    from tessera.functions.text import estimate_tokens

    c = table(spark, d, "conversations").select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))
    return G.token_budget(c, "conv_id", "turn", "tokens", 60)


def prompts(spark, d):
    c = table(spark, d, "conversations")
    ev = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), "text")))
    x = c.groupBy("conv_id").agg(ev.alias("ev"))
    return x.select("conv_id", F.md5(G.prompt(F.lit("What was said?"), F.col("ev"), 80)).alias("prompt_md5"), F.size("ev").alias("turns"))


def parse_json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.length(G.json_body(F.col("props"))).alias("body"))


def cost_summary(spark, d):
    e = table(spark, d, "events")
    tin, tout = F.length("props").cast("long"), F.floor(F.abs("value")).cast("long")
    ok = F.col("event_type") != "error"
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(tin).alias("tokens_in"), F.sum(tout).alias("tokens_out"), F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("failures"),
        G.cost(F.sum(tin), F.sum(tout), 0.5, 1.5).alias("usd"),
    )


def resume_antijoin(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return G.missing_rows(e.select("user_id", "day").distinct(), e.filter(F.col("event_type") == "purchase"), ["user_id", "day"])


def text_coverage(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg((F.length(F.trim("text")) > 0).cast("double")), 6).alias("coverage"))


def manifest_hash(spark, d):
    """A fingerprint of the corpus by language: of its texts' hashes in order, in 4,096 buckets, and then of the buckets in order."""
    docs = table(spark, d, "documents").select("lang", F.md5("text").alias("h"))
    part = docs.groupBy("lang", F.substring("h", 1, 3).alias("b")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("m"))
    return part.groupBy("lang").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: x["m"]), "")).alias("fingerprint"))


def events_tumbling(spark, d):
    """Beyond the evidence operators: events an hour and kind."""
    e = table(spark, d, "events")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    return e.groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def events_session(spark, d):
    """Beyond the evidence operators: a user's sessions, ended by half an hour without events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > 1_800_000_000).cast("int"), F.lit(1))
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("t") - F.min("t")).alias("micros"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_mentions, entity_sets, year_expand, query_type, metric_canonical, lexicon_longest, answer_eval, answer_eval_summary,
        verify_numbers, error_taxonomy, token_budget, prompts, parse_json_props, cost_summary, resume_antijoin, text_coverage, manifest_hash,
        events_tumbling, events_session,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_TXT = "txt AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"
_PAIR = """pairs AS MATERIALIZED (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant')"""
_ALLM = "(?i)" + "|".join(E.METRICS)


def _num(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '{E.NUMBERS}'), lambda x: trim(x))"


def _yr(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({t}, '{E.YEARS}'), lambda y: regexp_extract(y, '((?:19|20)[0-9]{{2}})', 1)))"


def _nn(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({x}), '\\$', '', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"
    for word, letter in (("million", "m"), ("billion", "b"), ("thousand", "k"), ("trillion", "t")):
        s = f"replace({s}, '{word}', '{letter}')"
    return f"regexp_replace({s}, '\\s+', '', 'g')"


def _nv(x: str) -> str:
    s = f"regexp_replace(lower({x}), '[$,%]', '', 'g')"
    return (
        f"(try_cast(trim(regexp_replace({s}, '[a-z]+', '', 'g')) AS DOUBLE) * CASE WHEN contains({s}, 'trillion') THEN 1e12 WHEN contains({s}, 'thousand') THEN 1e3 "
        f"WHEN contains({s}, 'billion') THEN 1e9 WHEN contains({s}, 'million') THEN 1e6 ELSE 1 END)"
    )


def _un(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({t}, '{E.UNITS}', 1), lambda u: lower(u)))"


def _na(t: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(regexp_replace({t}, '```(?:json)?\\s*', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), '\\s+', ' ', 'g'))"


def _ts(t: str) -> str:
    return f"list_distinct(list_filter(string_split({t}, ' '), lambda w: w <> ''))"


_MENT = f"""{_TXT}, men AS (
  SELECT id, 'number' AS kind, unnest(list_distinct({_num('text')})) AS value FROM txt UNION ALL SELECT id, 'year', unnest({_yr('text')}) FROM txt
  UNION ALL SELECT id, 'filing', unnest(list_distinct(list_transform(regexp_extract_all(text, '{E.FILINGS}'), lambda x: upper(x)))) FROM txt
  UNION ALL SELECT id, 'metric', unnest(list_distinct(list_transform(regexp_extract_all(text, '{_ALLM}'), lambda x: lower(trim(x))))) FROM txt
  UNION ALL SELECT id, 'company', unnest(list_distinct(regexp_extract_all(text, '{E.COMPANIES}', 1))) FROM txt)"""
_EV = f"""{_PAIR}, v AS MATERIALIZED (SELECT conv_id, turn, NOT regexp_matches(regexp_replace(lower(trim(answer)), '[.!]+$', ''), '^insufficient[\\s_]+evidence$') AS ok,
    {_na('answer')} AS a, {_na('question')} AS g, {_num('answer')} AS na, {_num('question')} AS ng, {_un('answer')} AS ua, {_un('question')} AS ug FROM pairs),
  t AS MATERIALIZED (SELECT *, {_ts('a')} AS ta, {_ts('g')} AS tg FROM v),
  ev AS MATERIALIZED (SELECT conv_id, turn, ok::INT AS answered, CASE WHEN ok THEN (a = g)::INT END AS exact,
    CASE WHEN ok THEN (CASE WHEN a = '' OR g = '' THEN false ELSE contains(a, g) OR contains(g, a) OR len(list_intersect(ta, tg)) >= 0.8 * len(tg) END)::INT END AS relaxed,
    CASE WHEN ok THEN round(CASE WHEN len(ta) = 0 AND len(tg) = 0 THEN 1.0::DOUBLE WHEN len(ta) = 0 OR len(tg) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(ta, tg)) / (len(ta) + len(tg)) END, 6) END AS f1,
    CASE WHEN ok AND (len(na) > 0 OR len(ng) > 0) THEN round(CASE WHEN len(na) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(na, lambda n: list_contains(list_transform(ng, lambda m: {_nn('m')}), {_nn('n')}))) / len(na) END, 6) END AS number_match,
    CASE WHEN ok AND (len(na) > 0 OR len(ng) > 0) THEN round(CASE WHEN len(na) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(na, lambda n: len(list_filter(ng, lambda m:
      coalesce(abs({_nv('n')} - {_nv('m')}) / greatest(abs({_nv('m')}), 1) < 0.01, false))) > 0)) / len(na) END, 6) END AS tolerance,
    CASE WHEN ok THEN CASE WHEN len(ua) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(ua, ug)) / len(ua), 6) END END AS unit_match FROM t)"""


def _any(t: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{n}')" for n in names) + ")"


def _first_alias(t: str) -> str:
    exact = " ".join(f"WHEN {t} = '{a}' THEN '{c}'" for a, c in PART_ALIASES)
    inside = " ".join(f"WHEN contains({t}, '{a}') THEN '{c}'" for a, c in PART_ALIASES)
    return f"CASE {exact} {inside} ELSE {t} END"


_NUMERIC = f"(regexp_matches(text, '[0-9]') OR regexp_matches(text, '{_ALLM}'))"
ORACLE_SQL = {
    "entity_mentions": f"WITH {_MENT} SELECT * FROM men",
    "entity_sets": f"WITH {_MENT} SELECT id, kind, string_agg(DISTINCT value, '|' ORDER BY value) AS entities FROM men GROUP BY id, kind",
    "year_expand": """WITH y AS (SELECT n_nationkey, unnest(list_concat(range(n_nationkey + 1995, n_nationkey + 1999), [2021, 2022, 2023])) AS y FROM nation)
        SELECT n_nationkey, string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR) AS years FROM y GROUP BY n_nationkey""",
    "query_type": f"""SELECT conv_id, turn, {_NUMERIC}::INT AS numeric, {_any('lower(text)', E.COMPARISON)}::INT AS comparing, {_any('lower(text)', E.EXPLANATION)}::INT AS explaining,
        (NOT ({_NUMERIC} OR {_any('lower(text)', E.COMPARISON)} OR {_any('lower(text)', E.EXPLANATION)}))::INT AS general FROM conversations""",
    "metric_canonical": f"SELECT p_partkey, {_first_alias(chr(116))} AS canonical FROM (SELECT p_partkey, trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g')) AS t FROM part)",
    "lexicon_longest": """WITH l(pattern, canonical) AS (VALUES """ + ", ".join(f"('{a}', '{c}')" for a, c in PART_ALIASES) + """)
        SELECT p_partkey, canonical FROM (SELECT p_partkey, canonical, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC, pattern DESC) AS n
          FROM part JOIN l ON contains(lower(p_type), pattern)) WHERE n = 1""",
    "answer_eval": f"WITH {_EV} SELECT * FROM ev",
    "answer_eval_summary": f"""WITH {_EV} SELECT count(*)::BIGINT AS pairs, sum(answered)::BIGINT AS answered, round(avg(relaxed), 6) AS relaxed, round(avg(f1), 6) AS f1,
        round(avg(number_match), 6) AS number_match, round(avg(unit_match), 6) AS unit_match FROM ev""",
    "verify_numbers": f"""WITH {_PAIR}, v AS (SELECT conv_id, turn, list_distinct(list_transform({_num('answer')}, lambda x: {_nn('x')})) AS na, list_transform({_num('question')}, lambda x: {_nn('x')}) AS ne,
          {_yr('answer')} AS ya, {_yr('question')} AS ye FROM pairs),
        r AS (SELECT conv_id, turn, len(list_filter(na, lambda x: NOT list_contains(ne, x)))::INT AS unsupported, (len(ya) = 0 OR len(ye) = 0 OR list_has_any(ya, ye)) AS ok FROM v)
        SELECT conv_id, turn, unsupported, ok::INT AS year_ok, (unsupported = 0 AND ok)::INT AS consistent FROM r""",
    "error_taxonomy": f"""WITH {_PAIR}, v AS (SELECT *, {_yr('question')} AS yq, {_yr('answer')} AS ya, list_sort({_un('question')}) AS uq, list_sort({_un('answer')}) AS ua,
          len(list_intersect({_ts(_na('answer'))}, {_ts(_na('question'))})) AS overlap FROM pairs)
        SELECT CASE WHEN length(answer) = 0 THEN 'unsupported' WHEN len(yq) > 0 AND len(ya) > 0 AND NOT list_has_any(yq, ya) THEN 'wrong_year'
          WHEN len(uq) > 0 AND len(ua) > 0 AND uq <> ua THEN 'unit_error' WHEN regexp_matches(question, '[0-9]') AND regexp_matches(answer, '[0-9]')
            AND replace(question, ',', '') <> replace(answer, ',', '') THEN 'arithmetic_error' WHEN overlap = 0 THEN 'missing_evidence' ELSE 'other' END AS error, count(*)::BIGINT AS n
        FROM v GROUP BY ALL""",
    "token_budget": """WITH RECURSIVE t AS (SELECT conv_id, turn, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::INT AS tokens,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        f AS (SELECT conv_id, turn, tokens, i, tokens <= 60 AS kept, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END::BIGINT AS used FROM t WHERE i = 1
          UNION ALL SELECT t.conv_id, t.turn, t.tokens, t.i, f.used + t.tokens <= 60, f.used + CASE WHEN f.used + t.tokens <= 60 THEN t.tokens ELSE 0 END
          FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
        SELECT conv_id, turn, tokens FROM f WHERE kept""",
    "prompts": """WITH x AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)
        SELECT conv_id, md5('Question: What was said?' || chr(10) || chr(10) || 'Evidence:' || chr(10) || string_agg('[' || i || '] (' || turn || ') ' ||
          CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END, chr(10) ORDER BY i)) AS prompt_md5, count(*)::INT AS turns FROM x GROUP BY conv_id""",
    "parse_json_props": "SELECT event_id, CASE WHEN json_valid(props) THEN length(props) END::INT AS body FROM events",
    "cost_summary": """SELECT event_type, count(*)::BIGINT AS calls, sum(length(props))::BIGINT AS tokens_in, sum(floor(abs(value))::BIGINT)::BIGINT AS tokens_out,
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failures, round((sum(length(props)) * 0.5::DOUBLE + sum(floor(abs(value))::BIGINT) * 1.5::DOUBLE) / 1e6, 8) AS usd
        FROM events GROUP BY event_type""",
    "resume_antijoin": """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
        SELECT DISTINCT user_id, day FROM e ANTI JOIN (SELECT user_id, day FROM e WHERE event_type = 'purchase') p USING (user_id, day)""",
    "text_coverage": "SELECT role, count(*)::BIGINT AS turns, round(avg((length(trim(text)) > 0)::INT), 6) AS coverage FROM conversations GROUP BY role",
    "manifest_hash": """WITH p AS (SELECT lang, substr(md5(text), 1, 3) AS b, md5(string_agg(md5(text), '' ORDER BY md5(text))) AS m FROM documents GROUP BY ALL)
        SELECT lang, md5(string_agg(m, '' ORDER BY b)) AS fingerprint FROM p GROUP BY lang""",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": """WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS t, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x)
        SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS events, (max(t) - min(t))::BIGINT AS micros FROM s GROUP BY user_id, session""",
}
