"""Input views in SQL that Spark and DuckDB both read.

Each view names the tables and views it needs; ``with_views`` prefixes a query with them.
"""

from casework.functions import terms

TERMS = list(dict.fromkeys(
    t for words in (*terms.INTENT_TERMS.values(), terms.DAMAGE_TERMS, terms.CHARGE_TERMS, terms.TOXIC_TERMS, terms.ESCALATE_TERMS)
    for t in words
))
QUOTED = [t.replace("'", "''").upper() if i % 5 == 0 else t.replace("'", "''") for i, t in enumerate(TERMS)]

# name -> (needs, SQL)
VIEWS = {
    # Every third conversation has second answers.
    "tweets_v": (("conversations",), """
SELECT conv_id * 100 + turn AS tweet_id,
  CASE WHEN role = 'assistant' THEN 'BrandSupport' ELSE 'cust_' || CAST(conv_id AS VARCHAR(20)) END AS author_id,
  text,
  CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS in_response_to_tweet_id
FROM conversations
UNION ALL
SELECT conv_id * 100 + 50 + turn, 'BrandSupport', 'And besides: ' || text, conv_id * 100 + turn - 1
FROM conversations WHERE role = 'assistant' AND turn > 0 AND conv_id % 3 = 0"""),
    "cases_v": (("conversations",), """
SELECT conv_id AS n, max(CASE WHEN turn = 0 THEN text END) AS customer_text, max(CASE WHEN turn = 1 THEN text END) AS agent_text
FROM conversations GROUP BY conv_id"""),
    "drafts_v": (("conversations",), """
SELECT conv_id AS thread_id, chr(34) || text || chr(34) AS answer FROM conversations WHERE turn = 1"""),
    "threads_v": (("tweets_v",), """
SELECT c.tweet_id AS thread_id, c.text AS customer_text, b.text AS agent_text
FROM tweets_v b JOIN tweets_v c ON c.tweet_id = b.in_response_to_tweet_id
WHERE b.author_id = 'BrandSupport' AND length(c.text) > 15"""),
    # Every term of every list stands in some message, after a whole turn of a conversation; every turn of
    # every conversation in several messages.
    "rows_v": (("events", "conversations"), f"""
SELECT e.event_id, e.user_id, e.event_type, CASE e.place
  WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || chr(10) || ' '
  WHEN 3 THEN repeat('long text ', 120)
  WHEN 4 THEN 'write to ann.lee+box@post.example.org, thanks' WHEN 5 THEN ' or ring +1 (743) 555-3824 '
  ELSE coalesce(d.text || ' ', '') || t.term || ' again' END AS customer_text
FROM (SELECT *, event_id % {len(TERMS) + 6} AS place, event_id % (SELECT max(conv_id) + 1 FROM conversations) AS conv,
  CAST(floor(event_id / (SELECT max(conv_id) + 1 FROM conversations)) AS BIGINT) % 8 AS turn_no FROM events) e
LEFT JOIN conversations d ON d.conv_id = e.conv AND d.turn = e.turn_no
LEFT JOIN (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(QUOTED, 6))}) AS t(place, term) ON t.place = e.place"""),
    "messages_v": (("rows_v",), "SELECT event_id AS thread_id, customer_text FROM rows_v"),
    "eval_v": (("rows_v",), """
SELECT event_id AS thread_id, customer_text,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE CASE (event_id * 7 + user_id) % 10
    WHEN 0 THEN 'account_security' WHEN 1 THEN 'hardware_repair' WHEN 2 THEN ' Software_Troubleshooting '
    WHEN 3 THEN 'billing_purchases' WHEN 4 THEN 'device_connectivity' WHEN 5 THEN 'other'
    ELSE 'general_inquiry' END END AS true_intent,
  CASE WHEN event_id % 37 = 0 THEN NULL ELSE CASE (event_id * 3 + user_id * 5) % 9
    WHEN 0 THEN 'account_security' WHEN 1 THEN 'Hardware_Repair' WHEN 2 THEN 'software_troubleshooting'
    WHEN 3 THEN 'billing_purchases' WHEN 4 THEN 'device_connectivity'
    ELSE 'general_inquiry' END END AS pred_intent,
  CAST((event_id * 13) % 101 AS DOUBLE) / 100 AS confidence_score,
  CASE event_id % 11 WHEN 0 THEN 'True' WHEN 1 THEN 'YES' WHEN 2 THEN '1' WHEN 3 THEN 't' WHEN 4 THEN NULL
    WHEN 5 THEN '1.0' WHEN 6 THEN ' y ' WHEN 7 THEN 'False' WHEN 8 THEN '0' WHEN 9 THEN 'no' ELSE 'maybe' END AS true_escalate,
  CASE user_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN NULL WHEN 2 THEN 'Y' ELSE 'false' END AS pred_escalate,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_type END AS escalation_reason,
  CASE WHEN event_id % 5 = 0 THEN 'reply ' || CAST(event_id AS VARCHAR(20)) WHEN event_id % 5 = 1 THEN '  ' END AS drafted_reply,
  CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id % 6 AS VARCHAR(20)) END AS retrieved_examples,
  CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 30 = 0 THEN 'bad' ELSE CAST(1 + event_id % 4 AS VARCHAR(20)) END END AS judge_tone,
  CASE WHEN event_id % 10 = 0 THEN CAST(1 + user_id % 5 AS VARCHAR(20)) END AS judge_grounding
FROM rows_v"""),
    "golden_v": (("eval_v",), """
SELECT thread_id, customer_text, true_intent,
  CASE WHEN true_escalate IS NOT NULL THEN CASE WHEN lower(true_escalate) IN ('true', 'yes', '1', 't') THEN 1 ELSE 0 END END AS should_escalate
FROM eval_v"""),
    "analysis_v": (("events",), """
SELECT event_id AS thread_id,
  CASE user_id % 4 WHEN 0 THEN 'general_inquiry' WHEN 1 THEN 'other' WHEN 2 THEN 'device_connectivity' ELSE 'account_security' END AS intent,
  CAST((event_id * 29) % 101 AS DOUBLE) / 100 AS confidence_score,
  event_id % 13 = 0 AS should_escalate,
  CASE WHEN event_id % 13 = 0 THEN 'model says so' ELSE '' END AS escalation_reason
FROM events"""),
    "answers_v": (("events",), """
SELECT event_id AS thread_id, CASE event_id % 11
  WHEN 0 THEN '{"intent":"other","confidence_score":0.9,"should_escalate":false,"escalation_reason":" x "}'
  WHEN 1 THEN '```json' || chr(10) || '{"intent":"hardware_repair","confidence_score":0.7,"should_escalate":true}' || chr(10) || '```'
  WHEN 2 THEN '{"intent":"refunds","confidence_score":"0.8","should_escalate":"false"}'
  WHEN 3 THEN '{"intent":null,"confidence_score":7,"should_escalate":0}'
  WHEN 4 THEN '{"confidence_score":-1,"should_escalate":1.5}'
  WHEN 5 THEN '{"confidence_score":"abc","should_escalate":[]}'
  WHEN 6 THEN 'not json'
  WHEN 7 THEN '[1]'
  WHEN 8 THEN ''
  WHEN 9 THEN '{"score_tone":5,"score_grounding":"4","reasoning":"ok"}'
  ELSE '{"score_tone":6,"score_grounding":null}' END AS answer
FROM events"""),
    # What Python's JSON reader takes and stricter ones don't.
    "lenient_v": (("events",), """
SELECT event_id AS thread_id, CASE event_id % 7
  WHEN 0 THEN '{"intent":"refunds","confidence_score":0.1,"intent":"other","confidence_score":"0.4"}'
  WHEN 1 THEN '{"intent":"hardware_repair","confidence_score":NaN,"should_escalate":NaN,"escalation_reason":NaN}'
  WHEN 2 THEN '{"confidence_score":-Infinity,"escalation_reason":["a",1,true,null,{"b c":' || CAST(user_id AS VARCHAR(20)) || '}]}'
  WHEN 3 THEN '{"confidence_score":Infinity,"should_escalate":1,"should_escalate":null,"escalation_reason":"NaN, Infinity"}'
  WHEN 4 THEN '{"confidence_score":0.5} and more'
  WHEN 5 THEN '{"confidence_score":0.5,}'
  ELSE '{"confidence_score":' || CAST(user_id % 100 AS VARCHAR(20)) || 'e-2,"escalation_reason":{"' || event_type || '":[]}}' END AS answer,
  user_id, event_type
FROM events"""),
    "label_events_v": (("events",), """
SELECT user_id AS thread_id, event_id AS seq,
  CAST(1 + event_id % 8 AS VARCHAR(20)) AS code,
  CASE WHEN event_id % 3 = 0 THEN 'y' WHEN event_id % 3 = 1 THEN 'Y' ELSE 'n' END AS escalate,
  event_type AS reason
FROM events"""),
    "errors_v": (("events",), """
SELECT event_id AS id, CASE event_id % 6
  WHEN 0 THEN 'HTTP 429 too many requests' WHEN 1 THEN 'Rate limit reached' WHEN 2 THEN 'model_unavailable'
  WHEN 3 THEN 'The model is currently unavailable' WHEN 4 THEN 'timeout' ELSE 'quota exceeded: model unavailable' END AS error
FROM events"""),
    "split_docs_v": (("documents",), """
SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'golden' ELSE 'kb' END AS split FROM documents"""),
}


def needed(names) -> list:
    """Views to declare, each after those it reads."""
    order = []

    def visit(name):
        if name in VIEWS and name not in order:
            for other in VIEWS[name][0]:
                visit(other)
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_views(names, query: str, tables: dict | None = None) -> str:
    """``query`` prefixed with its views; ``tables`` says how to read base tables."""
    views = needed(names)
    base = dict.fromkeys(t for n in [*views, *names] for t in VIEWS.get(n, ((n,),))[0] if t not in VIEWS)
    parts = [f"{t} AS ({tables[t]})" for t in base] if tables else []
    parts += [f"{v} AS ({VIEWS[v][1]})" for v in views]
    return (f"WITH {', '.join(parts)} " if parts else "") + query


def frame(spark, sf_dir: str, name: str):
    """View or base table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in ("conversations", "events", "documents")}
    return spark.sql(with_views([name], f"SELECT * FROM {name}", tables))
