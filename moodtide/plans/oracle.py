"""The registered queries in plain SQL, for a second engine over the same tables."""

from __future__ import annotations

from moodtide.operators.constraints import REQUIRED, UNIQUE_KEYS
from moodtide.fixed_values import CLEAN_CONTENT_CHARS

AS_OF = "TIMESTAMP '2024-01-30 23:00:00'"
DAY_START = "TIMESTAMP '2024-01-30 00:00:00'"
DAY_END = "TIMESTAMP '2024-01-31 00:00:00'"
CUTOFF = "TIMESTAMP '2024-01-15 23:00:00'"


def cleaned(text: str, limit: int | None = None) -> str:
    whole = (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        f"regexp_replace({text}, '<[^>]+>', '', 'g'), 'https?://[^\\s]+', '', 'g'), "
        "'\\$[^$]+\\$', '', 'g'), '[\\r\\n\\t]+', ' ', 'g'), '[ ]{2,}', ' ', 'g'), ' ')"
    )
    return whole if limit is None else f"substring({whole}, 1, {limit})"


def level(avg: str, sd: str) -> str:
    avg, sd = f"round({avg}, 12)", f"round({sd}, 12)"
    return (
        f"CASE WHEN {avg} >= 0.52 THEN CASE WHEN {sd} > 0.25 THEN '稳健型' ELSE '激进型' END "
        f"WHEN {avg} >= 0.45 THEN CASE WHEN {sd} > 0.25 THEN '保守型' ELSE '稳健型' END "
        "ELSE '保守型' END"
    )


def profile_of(source: str) -> str:
    return (
        "SELECT user_id, avg(sentiment_score) AS avg_sentiment, "
        "coalesce(stddev_samp(sentiment_score), 0.0) AS volatility, count(*) AS post_count "
        f"FROM {source} WHERE sentiment_score IS NOT NULL GROUP BY user_id HAVING count(*) >= 2"
    )


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def post_cte(by_day: bool = True) -> str:
    user = "CAST(user_id AS VARCHAR)"
    if by_day:
        user = f"concat({user}, '-', strftime(ts, '%m%d'))"
    return f"""{EV}, post0 AS (
      SELECT *, CAST(CASE WHEN event_type <> 'error' THEN 2 WHEN k % 2 = 1 THEN 1 ELSE 0 END
        AS INTEGER) AS process_status FROM ev
    ), post AS (
      SELECT event_id AS id,
        CASE WHEN event_id % 13 = 0 THEN concat(CAST(event_id * 7919 AS VARCHAR), 'x')
             WHEN event_id % 17 = 0 THEN concat('12345678', CAST(event_id * 7919 AS VARCHAR))
             ELSE CAST(event_id * 7919 AS VARCHAR) END AS source_post_id,
        {user} AS user_id, event_type AS topic,
        concat('<b>', event_type, '</b> https://x.example/', CAST(event_id AS VARCHAR), ' $', props,
               '$  end') AS content,
        process_status,
        CASE process_status WHEN 1 THEN CASE WHEN k % 3 = 0 THEN '' ELSE event_type END
             WHEN 2 THEN event_type END AS clean_content,
        CASE WHEN process_status = 2 THEN CAST(k AS DOUBLE) / 100.0 END AS sentiment_score,
        CASE WHEN process_status = 2 THEN CASE WHEN k < 40 THEN '悲观' WHEN k < 60 THEN '中立'
             ELSE '乐观' END END AS sentiment_label,
        ts AS post_time, ts AS create_time, ts AS update_time
      FROM post0
    )"""


POST = post_cte()
POST_PLAIN = post_cte(by_day=False)
PROFILE = f"profile0 AS ({profile_of('post')}), profile AS (SELECT *, {level('avg_sentiment', 'volatility')} AS risk_level FROM profile0)"

CATALOG = """catalog AS (
      SELECT p_partkey AS product_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS product_name,
        p_type AS product_type,
        CASE p_size % 3 WHEN 0 THEN '保守型' WHEN 1 THEN '稳健型' ELSE '激进型' END AS risk_rating,
        CAST(p_size AS DOUBLE) * CAST(0.5 AS DOUBLE) AS annual_yield,
        (p_retailprice - CAST(900.0 AS DOUBLE)) / CAST(5.0 AS DOUBLE) AS max_drawdown,
        CAST(p_partkey % 50 AS DOUBLE) / CAST(20.0 AS DOUBLE) AS sharpe_ratio,
        CASE p_partkey % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '{"x":"a","y":"b"}' ELSE '"plain"' END
          AS tags,
        CASE WHEN p_partkey % 7 <> 0 THEN concat('https://shop.example/', CAST(p_partkey AS VARCHAR))
        END AS purchase_url
      FROM part
    )"""

SCORE = (
    "annual_yield * CAST(0.4 AS DOUBLE) + sharpe_ratio * CAST(10 AS DOUBLE) * CAST(0.3 AS DOUBLE)"
    " - max_drawdown * {v} * CAST(1.2 AS DOUBLE)"
)

BEST = f"""WITH {POST}, {PROFILE}, {CATALOG}, scored AS (
      SELECT p.user_id, p.avg_sentiment, p.volatility, p.risk_level, c.*,
        {SCORE.format(v='p.volatility')} AS score
      FROM profile p JOIN catalog c ON c.risk_rating = p.risk_level
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rn
      FROM scored
    ), best AS (SELECT *, CAST(rn AS INTEGER) AS rank FROM ranked WHERE rn <= 3)"""

REASON = (
    "CASE WHEN round(volatility, 12) >= 0.20 THEN 'steady' WHEN round(avg_sentiment, 12) >= 0.60 AND annual_yield >= 12 "
    "THEN 'growth' ELSE 'balanced' END"
)

HOURLY = (
    "SELECT date_trunc('hour', post_time) AS hour, avg(sentiment_score) AS avg_score, "
    "count(*) AS posts FROM {source} WHERE sentiment_score IS NOT NULL GROUP BY 1"
)


def trend_ctes(keys: bool) -> str:
    """Fill by looking up the nearest known point on either side."""
    key = "user_id" if keys else "0"
    series = "SELECT DISTINCT user_id AS sk FROM post" if keys else "SELECT 0 AS sk"
    return f"""hourly AS (
      SELECT {key} AS sk, date_trunc('hour', post_time) AS hour, avg(sentiment_score) AS value
      FROM post WHERE sentiment_score IS NOT NULL AND post_time >= {DAY_START}
        AND post_time < {DAY_END} GROUP BY 1, 2
    ), g AS (SELECT coalesce(nullif(avg(sentiment_score), 0.0), 0.5) AS g FROM post),
    spine AS (
      SELECT sk, CAST(i AS INTEGER) AS idx, {DAY_START} + i * INTERVAL 1 HOUR AS hour
      FROM ({series}) s, range(24) t(i)
    ), points AS (
      SELECT s.sk, s.idx, s.hour, h.value FROM spine s LEFT JOIN hourly h USING (sk, hour)
    ), sided AS (
      SELECT *,
        max(CASE WHEN value IS NOT NULL THEN idx END) OVER (
          PARTITION BY sk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
        min(CASE WHEN value IS NOT NULL THEN idx END) OVER (
          PARTITION BY sk ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri
      FROM points
    ), filled AS (
      SELECT s.sk, s.idx, s.hour, strftime(s.hour, '%H:00') AS label,
        CASE WHEN s.value IS NOT NULL THEN s.value
             WHEN s.li IS NOT NULL AND s.ri IS NOT NULL
               THEN l.value + (r.value - l.value) / (s.ri - s.li) * (s.idx - s.li)
             WHEN s.ri IS NOT NULL THEN g + (r.value - g) / (s.ri + 1) * (s.idx + 1)
             WHEN s.li IS NOT NULL THEN l.value + (g - l.value) / (24 - s.li) * (s.idx - s.li)
             ELSE g END AS value,
        CASE WHEN s.value IS NOT NULL THEN 'real'
             WHEN s.li IS NOT NULL AND s.ri IS NOT NULL THEN 'interpolated'
             ELSE 'anchor' END AS point_type
      FROM sided s CROSS JOIN g
      LEFT JOIN points l ON l.sk = s.sk AND l.idx = s.li
      LEFT JOIN points r ON r.sk = s.sk AND r.idx = s.ri
    )"""


def newest(source: str, time: str, columns: str) -> str:
    return f"""SELECT *, CAST(count(*) OVER (PARTITION BY user_id) - back + 1 AS BIGINT) AS seq FROM (
        SELECT {columns}, row_number() OVER (PARTITION BY user_id ORDER BY {time} DESC, id DESC) AS back
        FROM {source} WHERE sentiment_score IS NOT NULL) WHERE back <= 10"""


DIRTY = "(length(source_post_id) < 8 OR length(source_post_id) > 11 OR regexp_matches(source_post_id, '[^0-9]'))"
VALID = "regexp_full_match(source_post_id, '[0-9]{8,11}')"

LABELS = """wordings AS (
      SELECT ['LABEL_0', ' Very-Positive ', 'neutral', 'NEG', 'bull_ish', '积极', '中性', '消极', NULL,
              'Pessimistic', 'non-neutral negative'] AS w
    ), models AS (
      SELECT p_partkey AS model_id, CAST((p_partkey // 4) % 4 + 1 AS INTEGER) AS num_labels, p_size
      FROM part
    ), outputs AS (
      SELECT model_id, num_labels, CAST(i AS INTEGER) AS label_index,
        w[CAST((model_id + i * p_size) % 11 AS INTEGER) + 1] AS raw_label
      FROM models, wordings, range(4) t(i) WHERE i < num_labels
    ), named AS (
      SELECT *, translate(lower(trim(coalesce(raw_label, ''))), '_-', '') AS name FROM outputs
    ), classed AS (
      SELECT *, CASE
        WHEN regexp_matches(name, 'positive|bullish|optimistic|乐观|积极|pos') THEN '乐观'
        WHEN regexp_matches(name, 'neutral|中立|中性|neu') THEN '中立'
        WHEN regexp_matches(name, 'negative|bearish|pessimistic|悲观|消极|neg') THEN '悲观' END
        AS class_label
      FROM named
    )"""

SOFTMAX = """z AS (
      SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
        CAST(embedding[3] AS DOUBLE) AS c FROM embeddings
    ), e AS (
      SELECT vec_id, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
        exp(c - greatest(a, b, c)) AS ec FROM z
    ), p AS (
      SELECT vec_id, ea / (ea + eb + ec) AS p_negative, eb / (ea + eb + ec) AS p_neutral,
        ec / (ea + eb + ec) AS p_positive FROM e
    )"""


def polarised(d: str) -> str:
    return f"greatest(0.0, least(1.0, 0.5 + 0.5 * sign({d}) * sqrt(abs({d}))))"


def lexicon(source: str, key: str, text: str, good: list[str], bad: list[str], extra: str = "") -> str:
    def hits(words: list[str]) -> str:
        listed = ", ".join(f"'{w}'" for w in words)
        return (
            f"CAST(len(list_filter(string_split_regex(lower({text}), '[ \\r\\n\\t]+'), "
            f"lambda w: w IN ({listed}))) AS DOUBLE)"
        )

    return f"""lz AS (SELECT {key}{extra}, {hits(bad)} AS a, CAST(1.0 AS DOUBLE) AS b, {hits(good)} AS c
      FROM {source}),
    le AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
      exp(c - greatest(a, b, c)) AS ec FROM lz),
    lp AS (SELECT *, ea / (ea + eb + ec) AS pn, eb / (ea + eb + ec) AS pu, ec / (ea + eb + ec) AS pp
      FROM le),
    lexed AS (SELECT *, {polarised('pp - pn')} AS score,
      CASE WHEN pn >= pu AND pn >= pp THEN '悲观' WHEN pu >= pp THEN '中立' ELSE '乐观' END AS lab
      FROM lp)"""


DOC_LEXICON = lexicon(
    "documents", "doc_id", "text", ["the", "und", "les", "que", "and"], ["of", "der", "le", "de", "die"]
)
DOC_SENTIMENT = f"WITH {DOC_LEXICON} SELECT doc_id, round(score, 6) AS score, lab AS sentiment_label FROM lexed"
POST_LEXICON = lexicon(
    "(SELECT * FROM post WHERE process_status = 1 AND clean_content IS NOT NULL AND clean_content <> '')",
    "id",
    "clean_content",
    ["purchase", "error"],
    ["view", "signup"],
    ", user_id, clean_content",
)

TIME_TEXTS = """texts AS (
      SELECT event_id, ts, CASE event_id % 12
        WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M')
        WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%m-%d %H:%M')
        WHEN 4 THEN strftime(ts, '%m/%d %H:%M') WHEN 5 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
        WHEN 6 THEN concat('  ', strftime(ts, '%Y-%-m-%-d %-H:%-M'), '  ')
        WHEN 7 THEN concat('02-29 ', strftime(ts, '%H:%M'))
        WHEN 8 THEN concat('posted ', strftime(ts, '%Y-%m-%d %H:%M'))
        WHEN 9 THEN concat(strftime(ts, '%Y-%m'), '-31 24:00') WHEN 10 THEN '' END AS time_text
      FROM events
    )"""

# What list pages hold, told from the events they are written from. A post counts when its id
# is valid and no empty link with the same id stands before it.
PAGE_POSTS = f"""{EV}, ids AS (
      SELECT *, event_id // 40 AS page_id, event_id % 5 AS variant,
        CASE WHEN event_id % 13 = 0 THEN concat(CAST(event_id * 7919 AS VARCHAR), 'x')
             WHEN event_id % 17 = 0 THEN concat('12345678', CAST(event_id * 7919 AS VARCHAR))
             ELSE CAST(event_id * 7919 AS VARCHAR) END AS source_post_id
      FROM ev
    ), page_post AS (
      SELECT page_id, source_post_id,
        CASE WHEN k % 10 = 0 AND variant IN (1, 2) THEN 'unknown'
             ELSE concat('u', CAST(user_id AS VARCHAR)) END AS user_id,
        concat('post', event_type, '& ', CAST(event_id AS VARCHAR)) AS content,
        CASE variant WHEN 0 THEN date_trunc('second', ts)
          WHEN 4 THEN {AS_OF} ELSE date_trunc('minute', ts) END AS post_time,
        CASE variant WHEN 0 THEN 'script_json' WHEN 1 THEN 'dom_time_tag' WHEN 2 THEN 'dom_time_tag'
          WHEN 3 THEN 'container_text_regex' ELSE 'not_found' END AS time_source
      FROM ids
      WHERE {VALID} AND NOT (event_id % 11 = 0 AND page_id % 4 <> 3)
    )"""

RECRAWL = """again AS (
      SELECT id + n * 1000000000 AS id,
        CASE WHEN id % 2 = 0 THEN source_post_id ELSE concat('new-', source_post_id) END
          AS source_post_id,
        user_id, concat(topic, '-', CAST(n AS VARCHAR)) AS topic, sentiment_score,
        post_time + n * INTERVAL 1 HOUR AS post_time, create_time,
        update_time + n * INTERVAL 1 HOUR AS update_time, n AS seq
      FROM post, (VALUES (1), (2)) t(n) WHERE id % 3 = 0
    ), winners AS (
      SELECT source_post_id, arg_min(id, seq) AS id, any_value(user_id) AS user_id,
        arg_min(topic, seq) AS topic, any_value(sentiment_score) AS sentiment_score,
        arg_max(post_time, seq) AS post_time, any_value(create_time) AS create_time,
        arg_max(update_time, seq) AS update_time
      FROM again GROUP BY source_post_id
    )"""


def build() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["clean_documents"] = f"SELECT doc_id, {cleaned('text')} AS clean FROM documents"
    sql["clean_limited"] = (
        f"SELECT doc_id, {cleaned('text', CLEAN_CONTENT_CHARS)} AS clean FROM documents"
    )
    sql["clean_pages"] = (
        f"SELECT page_id, {cleaned(chr(39).join(['concat(html, ', ' see ', ', url, ', '  end', ')']))}"
        " AS clean FROM pages"
    )
    sql["clean_conversations"] = (
        f"SELECT conv_id, turn, {cleaned('text')} AS clean FROM conversations"
    )
    sql["clean_posts"] = f"""WITH {POST} SELECT id, {cleaned("coalesce(content, '')", CLEAN_CONTENT_CHARS)} AS clean_content,
      {AS_OF} AS update_time FROM post WHERE process_status = 0"""

    sql["softmax_probabilities"] = f"""WITH {SOFTMAX} SELECT vec_id, round(p_negative, 9) AS p_negative,
      round(p_neutral, 9) AS p_neutral, round(p_positive, 9) AS p_positive FROM p"""
    sql["sentiment_score"] = (
        f"WITH {SOFTMAX} SELECT vec_id, round({polarised('p_positive - p_negative')}, 6) AS score FROM p"
    )
    sql["sentiment_label"] = f"""WITH {SOFTMAX} SELECT vec_id,
      CASE WHEN p_negative >= p_neutral AND p_negative >= p_positive THEN '悲观'
           WHEN p_neutral >= p_positive THEN '中立' ELSE '乐观' END AS label FROM p"""
    sql["label_classes"] = (
        f"WITH {LABELS} SELECT model_id, label_index, name, class_label FROM classed"
    )
    sql["label_mapping"] = f"""WITH {LABELS}, firsts AS (
      SELECT model_id, any_value(num_labels) AS n,
        min(label_index) FILTER (WHERE class_label = '乐观') AS fp,
        min(label_index) FILTER (WHERE class_label = '中立') AS fu,
        min(label_index) FILTER (WHERE class_label = '悲观') AS fn
      FROM classed GROUP BY model_id
    )
    SELECT c.model_id, c.label_index,
      coalesce(c.class_label,
        CASE WHEN n >= 3 THEN CASE c.label_index WHEN 0 THEN '悲观' WHEN 2 THEN '乐观' ELSE '中立' END
             WHEN n = 2 THEN CASE c.label_index WHEN 0 THEN '悲观' ELSE '乐观' END
             ELSE '中立' END) AS label,
      CAST(coalesce(fp, CASE WHEN n >= 3 THEN 2 WHEN n = 2 THEN 1 ELSE 0 END) AS INTEGER)
        AS positive_index,
      CAST(coalesce(fu, CASE WHEN n >= 3 THEN 1 WHEN n = 2 THEN coalesce(fn, 0) ELSE 0 END) AS INTEGER)
        AS neutral_index,
      CAST(coalesce(fn, 0) AS INTEGER) AS negative_index
    FROM classed c JOIN firsts USING (model_id)"""
    sql["lexicon_sentiment"] = DOC_SENTIMENT
    sql["model_sentiment"] = DOC_SENTIMENT

    sql["hashed_sentiment"] = f"""WITH {LABELS}, chosen AS (
        SELECT * FROM ({sql['label_mapping']}) WHERE model_id = (SELECT min(model_id) FROM classed WHERE num_labels = 3)
      ), meaning AS (SELECT any_value(positive_index) AS pi, any_value(negative_index) AS ni,
        list(label ORDER BY label_index) AS names FROM chosen),
      words AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \\r\\n\\t]+'),
        lambda w: w <> '')) AS word FROM documents),
      hashed AS (SELECT doc_id, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) % 1024 AS b FROM words),
      sums AS (SELECT doc_id, count(*) AS n, sum(CAST((b * 3) % 17 - 8 AS BIGINT)) AS s0,
        sum(CAST((b * 5 + 5) % 17 - 8 AS BIGINT)) AS s1, sum(CAST((b * 7 + 10) % 17 - 8 AS BIGINT)) AS s2
        FROM hashed GROUP BY doc_id),
      z AS (SELECT doc_id, list_transform([coalesce(s0, 0), coalesce(s1, 0), coalesce(s2, 0)],
        lambda s: CAST(s AS DOUBLE) / 16 / greatest(coalesce(n, 0), 1) * 8) AS z
        FROM documents LEFT JOIN sums USING (doc_id)),
      e AS (SELECT doc_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z),
      p AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
      SELECT doc_id, round({polarised('p[pi + 1] - p[ni + 1]')}, 6) AS score,
        names[list_position(p, list_max(p))] AS sentiment_label FROM p, meaning"""

    sql["pending_posts"] = (
        f"WITH {POST} SELECT id, coalesce(content, '') AS content FROM post WHERE process_status = 0"
    )
    sql["scorable_posts"] = f"""WITH {POST} SELECT id, user_id, clean_content FROM post
      WHERE process_status = 1 AND clean_content IS NOT NULL AND clean_content <> ''"""
    sql["status_counts"] = (
        f"WITH {POST} SELECT process_status, count(*) AS posts FROM post GROUP BY 1"
    )
    sql["score_details"] = (
        f"WITH {POST} SELECT user_id, sentiment_score FROM post WHERE sentiment_score IS NOT NULL"
    )
    sql["score_writeback"] = f"""WITH {POST}, {POST_LEXICON} SELECT id, round(score, 9) AS sentiment_score,
      lab AS sentiment_label, {AS_OF} AS update_time FROM lexed"""
    sql["sentiment_writeback"] = f"""WITH {POST}, {POST_LEXICON} SELECT id, id AS raw_data_id, user_id,
      clean_content, round(score, 9) AS sentiment_score, lab AS sentiment_label,
      {AS_OF} AS analyze_time FROM lexed"""
    sql["posts_in_range"] = f"""WITH {POST} SELECT id, post_time, sentiment_score FROM post
      WHERE sentiment_score IS NOT NULL AND post_time >= {DAY_START} AND post_time < {DAY_END}"""
    sql["products_of_level"] = f"""WITH {CATALOG} SELECT product_id, product_name, annual_yield
      FROM catalog WHERE risk_rating = '稳健型'"""
    sql["valid_post_ids"] = f"WITH {POST} SELECT id, source_post_id, {VALID} AS valid FROM post"

    sql["risk_profiles"] = f"""WITH {POST}, {PROFILE} SELECT user_id, round(avg_sentiment, 9) AS avg_sentiment,
      round(volatility, 9) AS volatility, post_count, risk_level FROM profile"""
    sql["missing_profiles"] = f"""WITH {POST}, {PROFILE} SELECT DISTINCT user_id FROM post
      WHERE user_id NOT IN (SELECT user_id FROM profile)"""
    sql["known_profiles"] = f"""WITH {POST}, {PROFILE} SELECT user_id, post_count, risk_level FROM profile
      WHERE user_id IN (SELECT user_id FROM post WHERE topic = 'error')"""
    sql["risk_distribution"] = f"""WITH {POST}, {PROFILE} SELECT risk_level, count(*) AS user_count,
      round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS user_share
      FROM profile GROUP BY risk_level"""
    sql["global_sentiment"] = f"""WITH {POST}, {PROFILE}, t AS (
      SELECT coalesce(avg(avg_sentiment), 0.0) AS a, count(*) AS n FROM profile)
      SELECT round(a, 9) AS global_avg_sentiment, n AS total_users,
        CASE WHEN round(a, 12) >= 0.6 THEN 'positive' WHEN round(a, 12) >= 0.4 THEN 'neutral_to_bearish' ELSE 'bearish' END
          AS market_band FROM t"""

    sql["global_post_score"] = f"""WITH {POST} SELECT
      round(coalesce(nullif(avg(sentiment_score), 0.0), 0.5), 9) AS global_score FROM post"""
    sql["hourly_sentiment"] = f"""WITH {POST}, h AS ({HOURLY.format(source='post')})
      SELECT hour, round(avg_score, 9) AS avg_score, posts FROM h"""
    sql["trend_24h"] = f"""WITH {POST}, {trend_ctes(False)}
      SELECT idx, hour, label, round(value, 9) AS value, point_type FROM filled"""
    sql["trend_24h_by_user"] = f"""WITH {POST_PLAIN}, {trend_ctes(True)}
      SELECT sk AS user_id, idx, hour, label, round(value, 9) AS value, point_type FROM filled"""
    sql["trend_deviation"] = f"""WITH {POST}, {PROFILE}, {trend_ctes(False)},
      m AS (SELECT coalesce(avg(avg_sentiment), 0.0) AS m FROM profile)
      SELECT idx, hour, label, round(value, 9) AS value, point_type,
        round(value - m, 9) + 0.0 AS deviation,
        CASE WHEN point_type = 'real' THEN round(value, 9) END AS real_value,
        CASE WHEN point_type <> 'real' THEN round(value, 9) END AS filled_value
      FROM filled CROSS JOIN m"""
    sql["trend_summary"] = f"""WITH {POST}, {trend_ctes(False)}
      SELECT round(avg(value), 9) AS mean_value,
        CAST(count(*) FILTER (WHERE point_type = 'real') AS BIGINT) AS real_points,
        CAST(count(*) FILTER (WHERE point_type <> 'real') AS BIGINT) AS filled_points,
        min(hour) AS start_time, max(hour) AS end_time,
        'linear_interpolation_with_global_edge_anchors' AS fill_strategy FROM filled"""

    sql["recommend_top3"] = f"""{BEST} SELECT user_id, risk_level, rank, product_id, product_name,
      product_type, annual_yield, max_drawdown, sharpe_ratio, round(score, 9) + 0.0 AS score,
      purchase_url FROM best"""
    sql["recommend_reason"] = (
        f"{BEST} SELECT user_id, rank, product_id, {REASON} AS reason_code FROM best"
    )
    sql["recommend_bands"] = f"""{BEST} SELECT user_id, rank, product_id,
      CASE WHEN round(score, 12) >= 9 THEN 'high' WHEN round(score, 12) >= 7.5 THEN 'mid' ELSE 'low' END AS score_band,
      CASE WHEN max_drawdown <= 1 THEN 'low' WHEN max_drawdown <= 10 THEN 'mid' ELSE 'high' END
        AS drawdown_band,
      CASE WHEN round(avg_sentiment, 12) >= 0.6 THEN 'high' WHEN round(avg_sentiment, 12) >= 0.4 THEN 'mid' ELSE 'low' END
        AS sentiment_band,
      CASE WHEN round(volatility, 12) > 0.15 THEN 'high' WHEN round(volatility, 12) >= 0.1 THEN 'mid' ELSE 'low' END
        AS volatility_band FROM best"""
    tags = "CASE product_id % 3 WHEN 2 THEN {plain} ELSE 'a|b' END"
    sql["recommend_answer"] = f"""{BEST} SELECT user_id, rank, product_id, product_name, risk_rating,
      {REASON} AS reason_code, true AS has_text,
      true AS two_places, true AS near_score, {tags.format(plain="''")} AS tags, purchase_url
      FROM best"""
    sql["product_scores"] = f"""WITH {CATALOG} SELECT product_id,
      round({SCORE.format(v='CAST(0.25 AS DOUBLE)')}, 9) + 0.0 AS score FROM catalog"""
    sql["catalog_listing"] = f"""WITH {CATALOG} SELECT
      CAST(CASE risk_rating WHEN '保守型' THEN 1 WHEN '稳健型' THEN 2 ELSE 3 END AS BIGINT) AS level_order,
      product_id, product_name, risk_rating, annual_yield, max_drawdown, sharpe_ratio FROM catalog
      ORDER BY level_order, annual_yield, product_id"""
    sql["catalog_tags"] = f"""WITH {CATALOG} SELECT product_id, {tags.format(plain="''")} AS tags,
      {tags.format(plain="'plain'")} AS shown_tags FROM catalog"""
    sql["catalog_reload"] = (
        f"WITH {CATALOG} SELECT risk_rating, count(*) AS products FROM catalog GROUP BY 1"
    )
    sql["table_inventory"] = f"""WITH {POST}, {CATALOG} SELECT * FROM (VALUES ('raw_data', 13, 0),
        ('user_sentiment', 7, 0), ('risk_profile', 6, 0), ('posts_scored', 4, 0)) t(name, columns, rows)
      UNION ALL SELECT 'posts_clean', 3, count(*) FROM post WHERE process_status = 0
      UNION ALL SELECT 'products', 9, count(*) FROM catalog"""
    sql["catalog_defaults"] = f"""WITH {CATALOG} SELECT product_id,
      CASE WHEN product_id % 5 = 0 THEN 0.0 ELSE round(max_drawdown, 9) END AS max_drawdown,
      CASE WHEN product_id % 11 = 0 THEN 0.0 ELSE sharpe_ratio END AS sharpe_ratio FROM catalog"""

    sql["user_history_10"] = f"""WITH {POST_PLAIN}, n AS (
      {newest('post', 'post_time', 'user_id, id, post_time, sentiment_score')})
      SELECT user_id, seq, strftime(post_time, '%m-%d %H:%M:%S') AS time,
        round(sentiment_score, 4) AS score FROM n"""
    sql["user_trend_10"] = f"""WITH {POST_PLAIN}, n AS (
      {newest('post', 'post_time', 'user_id, id, post_time, sentiment_score, sentiment_label')})
      SELECT user_id, seq, post_time AS analyze_time, sentiment_score, sentiment_label FROM n"""
    sql["user_series"] = f"""WITH {POST},
      kept AS (SELECT * FROM post WHERE create_time >= {CUTOFF}),
      hist AS ({newest('kept', 'post_time', 'user_id, id, post_time, sentiment_score')}),
      pts AS ({newest('post', 'post_time', 'user_id, id, post_time, sentiment_score')}),
      both_sides AS (SELECT user_id, seq, post_time, sentiment_score, 'history' AS origin FROM hist
        UNION ALL SELECT user_id, seq, post_time, sentiment_score, 'points' FROM pts
        WHERE user_id NOT IN (SELECT user_id FROM hist))
      SELECT user_id, seq, strftime(post_time, '%m-%d %H:%M:%S') AS time,
        round(sentiment_score, 4) AS score, origin FROM both_sides"""

    sql["upsert_posts"] = f"""WITH {POST}, {RECRAWL}
      SELECT coalesce(p.id, w.id) AS id, coalesce(p.source_post_id, w.source_post_id) AS source_post_id,
        coalesce(p.user_id, w.user_id) AS user_id, coalesce(p.topic, w.topic) AS topic,
        CASE WHEN p.id IS NOT NULL THEN p.sentiment_score ELSE w.sentiment_score END AS sentiment_score,
        coalesce(w.post_time, p.post_time) AS post_time,
        coalesce(p.create_time, w.create_time) AS create_time,
        coalesce(w.update_time, p.update_time) AS update_time
      FROM post p FULL OUTER JOIN winners w ON p.source_post_id = w.source_post_id"""
    sql["upsert_sentiment"] = f"""WITH {POST}, stored AS (
        SELECT id, id AS raw_data_id, user_id, clean_content, sentiment_score, sentiment_label,
          post_time AS analyze_time FROM post WHERE process_status = 2
      ), again AS (
        SELECT id + n * 1000000000 AS id,
          CASE WHEN raw_data_id % 8 = 0 THEN raw_data_id ELSE raw_data_id + 1000000000 END
            AS raw_data_id,
          user_id, clean_content, CAST(1.0 AS DOUBLE) - sentiment_score / n AS sentiment_score,
          sentiment_label, {AS_OF} AS analyze_time, n AS seq
        FROM stored, (VALUES (1), (2)) t(n) WHERE raw_data_id % 4 = 0
      ), first_rows AS (SELECT raw_data_id, id FROM again WHERE seq = 1),
      last_rows AS (SELECT * FROM again WHERE seq = 2)
      SELECT coalesce(s.id, f.id) AS id, raw_data_id, coalesce(l.user_id, s.user_id) AS user_id,
        coalesce(l.clean_content, s.clean_content) AS clean_content,
        round(coalesce(l.sentiment_score, s.sentiment_score), 9) AS sentiment_score,
        coalesce(l.sentiment_label, s.sentiment_label) AS sentiment_label,
        coalesce(l.analyze_time, s.analyze_time) AS analyze_time
      FROM stored s FULL OUTER JOIN last_rows l USING (raw_data_id)
      LEFT JOIN first_rows f USING (raw_data_id)"""
    sql["upsert_profiles"] = f"""WITH {POST_PLAIN},
      before AS (SELECT * FROM post WHERE post_time < {CUTOFF}),
      after AS (SELECT * FROM post WHERE post_time >= {CUTOFF}),
      old AS ({profile_of('before')}), new AS ({profile_of('after')}),
      merged AS (
        SELECT *, {AS_OF} AS update_time FROM new UNION ALL
        SELECT *, {CUTOFF} FROM old WHERE user_id NOT IN (SELECT user_id FROM new))
      SELECT user_id, round(avg_sentiment, 9) AS avg_sentiment, round(volatility, 9) AS volatility,
        post_count, {level('avg_sentiment', 'volatility')} AS risk_level, update_time FROM merged"""
    sql["prune_posts"] = f"""WITH {POST} SELECT id, source_post_id, create_time FROM post
      WHERE create_time >= {CUTOFF}"""
    sql["prune_summary"] = f"""WITH {POST} SELECT
      CAST(count(*) FILTER (WHERE create_time < {CUTOFF}) AS BIGINT) AS deleted,
      CAST(count(*) FILTER (WHERE create_time >= {CUTOFF}) AS BIGINT) AS kept FROM post"""
    sql["purge_dirty_ids"] = f"WITH {POST} SELECT id, source_post_id FROM post WHERE NOT {DIRTY}"
    sql["dirty_summary"] = f"""WITH {POST} SELECT CAST(count(*) FILTER (WHERE {DIRTY}) AS BIGINT) AS dirty,
      CAST(count(*) FILTER (WHERE NOT {DIRTY}) AS BIGINT) AS remaining FROM post"""
    sql["dirty_sample"] = f"""WITH {POST} SELECT source_post_id,
      CAST(length(source_post_id) AS INTEGER) AS id_len, substring(content, 1, 30) AS content_start
      FROM post WHERE {DIRTY} ORDER BY id LIMIT 10"""
    sql["constraint_violations"] = f"""WITH {POST}, doubled AS (
        SELECT CASE WHEN id % 10 = 0 THEN '00000000' ELSE source_post_id END AS source_post_id FROM post
      ), scores AS (
        SELECT CASE WHEN id % 9 = 0 THEN -1 ELSE id END AS raw_data_id FROM post WHERE process_status = 2)
      SELECT 'raw_data.source_post_id unique' AS constraint_name, count(*) AS violations FROM
        (SELECT source_post_id FROM doubled GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'user_sentiment.raw_data_id unique', count(*) FROM
        (SELECT raw_data_id FROM scores GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'user_sentiment.raw_data_id exists', count(*) FROM scores
        WHERE raw_data_id NOT IN (SELECT id FROM post)
      UNION ALL SELECT 'raw_data.user_id', count(*) FROM post WHERE user_id IS NULL
      UNION ALL SELECT 'raw_data.clean_content', count(*) FROM post WHERE clean_content IS NULL
      UNION ALL SELECT 'raw_data.sentiment_score', count(*) FROM post WHERE sentiment_score IS NULL"""
    spoilt = {
        "raw_data": """SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN '00000000' ELSE source_post_id END AS source_post_id,
          CASE WHEN id % 11 <> 0 THEN user_id END AS user_id) FROM post""",
        "user_sentiment": f"""SELECT CASE WHEN id % 9 = 0 THEN -1 ELSE id END AS raw_data_id, user_id, clean_content,
          sentiment_score, CASE WHEN id % 13 <> 0 THEN sentiment_label END AS sentiment_label, {AS_OF} AS analyze_time
          FROM post WHERE process_status = 2""",
        "risk_profile": """SELECT * REPLACE (CASE WHEN post_count % 5 = 0 THEN 'twice' ELSE user_id END AS user_id,
          CASE WHEN post_count <> 3 THEN risk_level END AS risk_level) FROM profile""",
        "products": """SELECT * REPLACE (CASE WHEN product_id % 7 = 0 THEN 'same name' ELSE product_name END AS product_name)
          FROM catalog""",
    }
    doubled = [
        f"SELECT '{t}.{key} unique' AS constraint_name, count(*) AS violations FROM "
        f"(SELECT {key} FROM ({spoilt[t]}) WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        for t, key in UNIQUE_KEYS.items()
    ]
    missing = [
        f"SELECT '{t}.{column}', count(*) FROM ({spoilt[t]}) WHERE {column} IS NULL"
        for t, columns in REQUIRED.items() for column in columns
    ]
    sql["constraint_report"] = f"WITH {POST}, {PROFILE}, {CATALOG} " + " UNION ALL ".join(doubled + missing)
    sql["restamped_posts"] = f"""WITH {POST} SELECT id, process_status,
      CASE WHEN process_status = 0 THEN {AS_OF} ELSE update_time END AS update_time FROM post"""

    sql["page_scan"] = "SELECT page_id, url, CAST(length(html) AS INTEGER) AS chars FROM pages"
    sql["page_backfill"] = """SELECT page_id, url FROM pages
      WHERE page_id BETWEEN 1 AND (SELECT max(page_id) / 2 FROM pages)"""
    sql["page_links"] = """WITH found AS (
        SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS link,
          generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos
        FROM pages
      ), parts AS (
        SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(link, 'href="([^"]*)"', 1) AS href,
          trim(regexp_extract(link, '>([^<]*)<', 1)) AS text FROM found
      )
      SELECT page_id, pos, href, text FROM parts
      QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1"""
    sql["parse_post_times"] = f"""WITH {TIME_TEXTS} SELECT event_id, CASE event_id % 12
        WHEN 2 THEN date_trunc('second', ts) WHEN 0 THEN date_trunc('minute', ts)
        WHEN 1 THEN date_trunc('minute', ts) WHEN 6 THEN date_trunc('minute', ts)
        WHEN 3 THEN coalesce(try_strptime(concat('2024-', time_text), '%Y-%m-%d %H:%M'), {AS_OF})
        WHEN 4 THEN coalesce(try_strptime(concat('2024/', time_text), '%Y/%m/%d %H:%M'), {AS_OF})
        ELSE {AS_OF} END AS post_time FROM texts"""
    sql["visible_times"] = f"""WITH {TIME_TEXTS} SELECT event_id, nullif(regexp_extract(time_text,
        '(\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}\\s+\\d{{2}}:\\d{{2}}(?::\\d{{2}})?|\\d{{2}}[-/]\\d{{2}}\\s+\\d{{2}}:\\d{{2}})', 1),
        '') AS found FROM texts"""
    sql["page_posts"] = f"WITH {PAGE_POSTS} SELECT * FROM page_post"
    sql["ingest_counters"] = f"""WITH {PAGE_POSTS} SELECT
      (SELECT count(DISTINCT event_id // 40) FROM events) AS pages,
      count(DISTINCT page_id) AS pages_with_posts, CAST(count(*) AS BIGINT) AS upsert_rows,
      count(DISTINCT source_post_id) AS distinct_posts FROM page_post"""

    sql["stream_hourly"] = f"""WITH {POST}, h AS ({HOURLY.format(source='post')})
      SELECT hour, round(avg_score, 9) AS avg_score, posts FROM h WHERE hour + INTERVAL 1 HOUR <=
        (SELECT max(post_time) FROM post WHERE sentiment_score IS NOT NULL) - INTERVAL 1 HOUR"""
    sql["stream_dedup"] = f"WITH {POST} SELECT id, source_post_id, post_time FROM post"
    whole = cleaned("coalesce(content, '')")
    sql["stream_clean"] = f"""WITH {POST} SELECT id, user_id, {whole} AS clean_content, {AS_OF} AS update_time
      FROM post"""
    texts = f"(SELECT * FROM (SELECT id, user_id, {whole} AS clean_content FROM post) WHERE clean_content <> '')"
    words = lexicon(texts, "id", "clean_content", ["purchase", "error"], ["view", "signup"], ", user_id, clean_content")
    sql["stream_score"] = f"""WITH {POST}, {words} SELECT id, id AS raw_data_id, user_id, clean_content,
      round(score, 9) AS sentiment_score, lab AS sentiment_label, {AS_OF} AS analyze_time FROM lexed"""
    sql["stream_hourly_all"] = sql["hourly_sentiment"]
    sql["stream_profiles"] = sql["risk_profiles"]
    sql["stream_ingest"] = f"""WITH {PAGE_POSTS} SELECT CAST(source_post_id AS BIGINT) AS id,
      source_post_id, user_id, content, post_time, {AS_OF} AS create_time,
      CAST(0 AS INTEGER) AS process_status FROM page_post"""
    sql["stream_counters"] = sql["ingest_counters"]
    sql["stream_correction"] = f"""WITH {POST}, moved AS (
        SELECT sentiment_score, CASE WHEN id % 7 = 0 THEN post_time + INTERVAL 2 HOUR ELSE post_time END
          AS post_time FROM post),
      h AS ({HOURLY.format(source='moved')}) SELECT hour, round(avg_score, 9) AS avg_score, posts FROM h"""
    return sql
