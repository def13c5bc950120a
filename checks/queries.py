"""Registered queries: one per operator, each over whole tables."""

from pyspark.sql import functions as F

from casework.functions import rules, terms, text
from casework.functions.answers import parse_answers, parse_judgements
from casework.functions.prompts import Templates
from casework.operators import labels, metrics, retrieve, seeded, threads, triage
from casework.plans import increments, reports, workflow
from casework.sources import schemas, tables, versions
from casework.sources.tables import shared_folder
from casework.streaming import batches, streams
from casework.streaming import labels as label_streams
from checks.views import frame, with_views

QUERIES = {}

TEMPLATES = Templates(
    classify="Kinds: {intents}\nSigns: {signals}\nText: {message}\nAnswer {\"a\": 1} with {keys}",
    reply="Earlier:\n{cases}\n---\n{message}",
    judge="{message}\n=>\n{reply}\n({keys})",
)
#: Rows of the golden side; fewer than there are threads.
GOLDEN = 20


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pairs(spark, sf):
    return metrics.pair_counts(frame(spark, sf, "eval_v"), "true_intent", "pred_intent")


# Metrics and reports over the evaluation results.

@query
def class_metrics(spark, sf):
    return metrics.class_metrics(_pairs(spark, sf))


@query
def confusion_intent(spark, sf):
    return reports.confusion_matrices(frame(spark, sf, "eval_v"))["intent"]


@query
def confusion_escalation(spark, sf):
    return reports.confusion_matrices(frame(spark, sf, "eval_v"))["escalation"]


@query
def executive_summary(spark, sf):
    return reports.executive_summary(frame(spark, sf, "eval_v"))


@query
def weighted_prf(spark, sf):
    return metrics.weighted_prf(metrics.class_metrics(_pairs(spark, sf)))


@query
def classification_report(spark, sf):
    return metrics.classification_report(_pairs(spark, sf))


@query
def accuracy(spark, sf):
    return metrics.accuracy(frame(spark, sf, "eval_v"), "true_intent", "pred_intent")


@query
def label_union(spark, sf):
    return metrics.label_union(_pairs(spark, sf))


@query
def label_distribution(spark, sf):
    return reports.intent_distribution(frame(spark, sf, "eval_v"))


@query
def majority_label(spark, sf):
    return reports.majority_labels(frame(spark, sf, "eval_v"))


@query
def accuracy_comparison(spark, sf):
    return reports.accuracy_comparison(frame(spark, sf, "eval_v"))


@query
def baseline_report(spark, sf):
    return reports.baseline_report(frame(spark, sf, "eval_v"))


@query
def evaluation_report(spark, sf):
    return reports.evaluation_report(frame(spark, sf, "eval_v"))


@query
def dataset_audit(spark, sf):
    return reports.dataset_audit(
        frame(spark, sf, "eval_v"), seeded.golden_split(frame(spark, sf, "threads_v"), GOLDEN)
    )


@query
def judge_scores(spark, sf):
    return reports.judge_scores(frame(spark, sf, "eval_v"))


@query
def safety_failures(spark, sf):
    return reports.safety_failures(frame(spark, sf, "eval_v"))


@query
def failure_cases(spark, sf):
    return reports.failure_cases(frame(spark, sf, "eval_v"))


@query
def intent_mismatches(spark, sf):
    found = reports.mismatches(frame(spark, sf, "eval_v"))
    return found.select("thread_id", "pred_intent", "true_intent")


@query
def mismatch_cases(spark, sf):
    """Every mismatch with its case number, in the order of ids."""
    found = reports.mismatches(frame(spark, sf, "eval_v")).select("thread_id", "pred_intent", "true_intent")
    return reports.numbered_cases(found, "#MM-")


@query
def raw_mismatches(spark, sf):
    """Labels compared as they are."""
    return reports.failure_cases(frame(spark, sf, "eval_v"), n=None, considered=None, normalize=False)


@query
def evaluation_report_raw(spark, sf):
    return reports.evaluation_report(frame(spark, sf, "eval_v"), normalize=False)


@query
def confusion_wide(spark, sf):
    classes = terms.INTENTS
    return metrics.confusion_wide(metrics.confusion_matrix(_pairs(spark, sf), classes), classes)


@query
def diagnostics(spark, sf):
    return reports.diagnostics(frame(spark, sf, "eval_v"))


@query
def dashboard(spark, sf):
    return reports.dashboard(frame(spark, sf, "eval_v"))


@query
def toxic_rule_quality(spark, sf):
    found = frame(spark, sf, "documents").select(
        "doc_id", rules.signals("text")["toxic"].alias("rule")
    )
    both = found.join(frame(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return metrics.binary_prf(metrics.binary_counts(both, F.col("toxic") == 1, F.col("rule")))


# Evaluation bookkeeping.

@query
def judge_sample(spark, sf):
    return triage.judge_sample(frame(spark, sf, "eval_v")).select("thread_id")


@query
def apply_judgements(spark, sf):
    results = frame(spark, sf, "eval_v")
    unjudged = results.filter(text.has_reply("drafted_reply") & F.col("judge_tone").isNull())
    scores = unjudged.select(
        "thread_id",
        (1 + F.length("drafted_reply") % 5).cast("int").alias("judge_tone"),
        (1 + F.length("customer_text") % 5).cast("int").alias("judge_grounding"),
    )
    done = triage.apply_judgements(results, scores)
    return done.select("thread_id", "judge_tone", "judge_grounding")


@query
def pending(spark, sf):
    done = frame(spark, sf, "eval_v").filter(F.col("pred_intent").isNotNull())
    return triage.pending(frame(spark, sf, "messages_v"), done).select("thread_id")


@query
def append_results(spark, sf):
    results = frame(spark, sf, "eval_v")
    old = results.filter(F.col("pred_escalate").isNotNull())
    new = results.filter(F.col("pred_escalate").isNull()).drop("judge_tone", "judge_grounding")
    return triage.append_results(old, new).select("thread_id", "pred_intent", "judge_tone")


@query
def label_queue(spark, sf):
    return labels.label_queue(frame(spark, sf, "eval_v")).select("thread_id")


@query
def apply_labels(spark, sf):
    events = frame(spark, sf, "label_events_v")
    done = labels.apply_labels(events.select("thread_id").distinct(), events)
    return done.withColumnRenamed("escalation_reason", "reason")


@query
def error_class(spark, sf):
    return frame(spark, sf, "errors_v").select("id", text.error_class("error").alias("error_class"))


def _judge(prompts):
    return [f'{{"score_tone":{1 + len(p) % 5},"score_grounding":3,"reasoning":"r"}}' for p in prompts]


@query
def judge_again(spark, sf):
    """Two runs of the judge: 20 threads, each judged once, some of them without a message."""
    folder = shared_folder(spark, "judge")
    results = frame(spark, sf, "eval_v").drop("judge_tone", "judge_grounding").withColumn(
        "customer_text", F.when(F.col("thread_id") % 4 != 0, F.col("customer_text"))
    )
    results = results.withColumn("thread_id", F.col("thread_id").cast("string"))
    for _ in range(2):
        done = workflow.run_judge(results, _judge, TEMPLATES.judge, folder)
    return done.select("thread_id", "judge_tone", "judge_grounding")


def _classify(prompts):
    """Answers that follow from the length of the message alone."""
    out = []
    for p in prompts:
        n = len(p.split("Text: ", 1)[1].rsplit("\nAnswer ", 1)[0])
        out.append(f'{{"intent":"{terms.INTENTS[n % 7]}","confidence_score":{(n % 10) / 10},"should_escalate":false}}')
    return out


@query
def evaluate(spark, sf):
    """The whole evaluation: a result or a reject for every golden row."""
    folder = shared_folder(spark, "evaluation")
    done = workflow.evaluate(spark, frame(spark, sf, "golden_v"), _classify, TEMPLATES, folder)
    rejects = spark.read.parquet(f"{folder}/rejects").select(
        "thread_id", F.col("reason").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in _EVALUATED.items()]
    )
    return done.select("thread_id", F.col("agent_status").alias("status"), *_EVALUATED).unionByName(rejects)


_EVALUATED = {"pred_intent": "string", "true_intent": "string", "true_escalate": "boolean"}


# Rules over message text.

@query
def signals(spark, sf):
    rows = triage.with_signals(frame(spark, sf, "messages_v"))
    return rows.select("thread_id", "signals.*")


@query
def pii_documents(spark, sf):
    return frame(spark, sf, "documents").select(
        "doc_id", rules.has_email("text").alias("has_email"), rules.has_phone("text").alias("has_phone")
    )


@query
def document_rules(spark, sf):
    return frame(spark, sf, "documents").select(
        "doc_id", rules.signals("text").alias("s"), rules.keyword_intent("text").alias("intent"),
        rules.keyword_escalate("text").alias("escalate"),
    ).select("doc_id", "s.*", "intent", "escalate")


@query
def keyword_intent(spark, sf):
    return frame(spark, sf, "messages_v").select(
        "thread_id", rules.keyword_intent("customer_text").alias("intent")
    )


@query
def keyword_escalate(spark, sf):
    return frame(spark, sf, "messages_v").select(
        "thread_id", rules.keyword_escalate("customer_text").alias("escalate")
    )


@query
def valid_messages(spark, sf):
    return triage.checked_messages(frame(spark, sf, "messages_v")).select(
        "thread_id", F.col("message_status").alias("status"), F.col("customer_text").alias("text")
    )


@query
def triage_rules(spark, sf):
    analysis = frame(spark, sf, "analysis_v").select(
        "thread_id",
        F.struct("intent", "confidence_score", "should_escalate", "escalation_reason").alias("analysis"),
    )
    messages = triage.valid_messages(triage.checked_messages(frame(spark, sf, "messages_v")))
    return triage.decide(messages.join(analysis, "thread_id")).select(
        "thread_id", "analysis.intent", "analysis.should_escalate",
        F.col("analysis.escalation_reason").alias("reason"), "status",
    )


@query
def clip_reply(spark, sf):
    return frame(spark, sf, "threads_v").select(
        "thread_id", text.clip_reply("agent_text").alias("reply")
    )


# Answers and requests.

@query
def parse_answer(spark, sf):
    a = F.col("analysis")
    return parse_answers(frame(spark, sf, "answers_v")).select(
        F.col("thread_id").alias("id"), a["intent"].alias("intent"),
        a["confidence_score"].alias("confidence"), a["should_escalate"].alias("escalate"),
        a["escalation_reason"].alias("reason"), "error",
    )


@query
def lenient_answers(spark, sf):
    a = F.col("analysis")
    return parse_answers(frame(spark, sf, "lenient_v")).select(
        F.col("thread_id").alias("id"), a["intent"].alias("intent"), a["confidence_score"].alias("confidence"),
        a["should_escalate"].alias("escalate"), a["escalation_reason"].alias("reason"), "error",
    )


@query
def parse_judgement(spark, sf):
    j = F.col("judgement")
    return parse_judgements(frame(spark, sf, "answers_v")).select(
        F.col("thread_id").alias("id"), j["score_tone"].alias("tone"),
        j["score_grounding"].alias("grounding"),
    )


def _valid(spark, sf):
    return triage.valid_messages(triage.checked_messages(frame(spark, sf, "messages_v")))


@query
def requests(spark, sf):
    messages = _valid(spark, sf)
    sampled = triage.judge_sample(frame(spark, sf, "eval_v"))
    return (
        triage.classification_requests(messages, TEMPLATES.classify)
        .unionByName(triage.reply_requests(messages, None, TEMPLATES.reply))
        .unionByName(triage.judge_requests(sampled, TEMPLATES.judge))
    )


@query
def score_batches(spark, sf):
    def scorer(prompts):
        return [
            TimeoutError("timeout") if "crash" in p.lower() else f'{{"chars":{len(p)}}}' for p in prompts
        ]

    rows = _valid(spark, sf).select(
        F.col("thread_id").cast("string").alias("id"), F.col("customer_text").alias("prompt")
    )
    return triage.score_batches(rows, scorer)


@query
def triage_batch(spark, sf):
    answers = frame(spark, sf, "answers_v").select(
        F.col("thread_id").alias("id"), "answer", F.lit(None).cast("string").alias("error")
    )
    drafts = frame(spark, sf, "drafts_v").select(
        F.col("thread_id").alias("id"), "answer", F.lit(None).cast("string").alias("error")
    )
    near = _nearest(retrieve.similar_issues, spark, sf, 3)
    return triage.triage_batch(_valid(spark, sf), answers, near, drafts).select(
        "thread_id", "status", "analysis.intent", F.col("analysis.escalation_reason").alias("reason"),
        "reply", "retrieved_examples", "error",
    )


# Threads, splits and the knowledge base.

@query
def pair_threads(spark, sf):
    tweets = frame(spark, sf, "tweets_v")
    return threads.pair_threads(tweets, threads.brand_replies(tweets, "BrandSupport"))


@query
def reply_parents(spark, sf):
    tweets = frame(spark, sf, "tweets_v")
    replies = threads.brand_replies(tweets, "BrandSupport")
    return threads.reply_parents(tweets, replies).select("tweet_id")


@query
def extract_threads(spark, sf):
    return threads.extract_threads(frame(spark, sf, "tweets_v"), "BrandSupport", replies=30, threads=20)


@query
def all_threads(spark, sf):
    return threads.extract_threads(frame(spark, sf, "tweets_v"), "BrandSupport")


@query
def seeded_sample(spark, sf):
    ids = frame(spark, sf, "threads_v").select("thread_id").distinct()
    return seeded.seeded_sample(ids, 15, "thread_id", 42)


@query
def golden_split(spark, sf):
    return seeded.golden_split(frame(spark, sf, "threads_v"), GOLDEN).select("thread_id", "split")


@query
def leakage_audit(spark, sf):
    return threads.leakage_audit(frame(spark, sf, "split_docs_v"), "doc_id", "text")


@query
def knowledge_base(spark, sf):
    split = seeded.golden_split(frame(spark, sf, "threads_v"), GOLDEN)
    return threads.build_knowledge_base(split.filter(F.col("split") == "kb"))


@query
def prepare(spark, sf):
    """A base stored with another split is kept, and the audit finds what it holds of the new one."""
    folder = shared_folder(spark, "prepare")
    tweets = frame(spark, sf, "tweets_v")
    workflow.prepare(tweets, "BrandSupport", folder, golden=GOLDEN // 2)
    return workflow.prepare(tweets, "BrandSupport", folder, golden=GOLDEN).leaks


# Retrieval: every stored vector against all others.

def _vectors(spark, sf):
    return frame(spark, sf, "embeddings").select("vec_id", "embedding")


def _nearest(search, spark, sf, k):
    v = _vectors(spark, sf)
    return search(v, v, k, query_id="vec_id", kb_id="vec_id", exclude_self=True)


@query
def similar_issues(spark, sf):
    return _rounded(_nearest(retrieve.similar_issues, spark, sf, 5))


def _rounded(found):
    return found.select("q", "n", "rk", F.bround("distance", 6).alias("distance"))


def _repeated(spark, sf):
    """Vectors that stand several times, under their own id and under that of another one."""
    v = _vectors(spark, sf)
    more = v.filter("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1)
    return v.unionByName(v.filter("vec_id % 5 = 0")).unionByName(v.filter("vec_id % 5 = 0")).unionByName(more)


@query
def similar_issues_repeated(spark, sf):
    """Several cells, ids with several vectors and rows that repeat."""
    found = retrieve.similar_issues(
        _vectors(spark, sf), _repeated(spark, sf), 4, query_id="vec_id", kb_id="vec_id", exclude_self=True, pivots=16
    )
    return _rounded(found)


@query
def similar_issues_cosine(spark, sf):
    v = _vectors(spark, sf)
    found = retrieve.similar_issues(
        v, v, 3, query_id="vec_id", kb_id="vec_id", metric="cosine", exclude_self=True
    )
    return _rounded(found)


@query
def similar_issues_lsh(spark, sf):
    return _nearest(retrieve.similar_issues_lsh, spark, sf, 5).select("q", "n", "rk")


#: Hash tables and bits of the search whose buckets the oracle forms as well.
BUCKETS = (12, 5)


@query
def similar_issues_buckets(spark, sf):
    """Neighbours among those that share a bucket, in given tables."""
    v, (tables_, bits) = _vectors(spark, sf), BUCKETS
    found = retrieve.similar_issues_lsh(v, v, 5, "vec_id", "vec_id", exclude_self=True, tables=tables_, bits=bits)
    return _rounded(found)


@query
def similar_issues_tiles(spark, sf):
    """The exact search in tiles of 100 rows on either side."""
    v = _vectors(spark, sf)
    return _rounded(retrieve.similar_issues(v, v, 5, "vec_id", "vec_id", exclude_self=True, tile_rows=100))


@query
def rag_evidence(spark, sf):
    found = retrieve.rag_evidence(_nearest(retrieve.similar_issues, spark, sf, 1), frame(spark, sf, "cases_v"))
    return found.withColumn("distance", F.bround("distance", 6))


@query
def reply_requests(spark, sf):
    cases = frame(spark, sf, "cases_v").select(
        F.col("n").cast("string").alias("id"), F.col("customer_text").alias("document"),
        F.col("agent_text").alias("agent_reply"),
    )
    messages = frame(spark, sf, "messages_v").filter(F.col("customer_text").isNotNull())
    near = _nearest(retrieve.similar_issues, spark, sf, 5)
    return triage.reply_requests(messages, retrieve.retrieved_cases(near, cases), TEMPLATES.reply)


# Tables written and read back.

@query
def read_tweets(spark, sf):
    """CSV with quotes, line breaks and ids as decimals, in several files."""
    folder = shared_folder(spark, "csv")
    raw = frame(spark, sf, "tweets_v").select(
        "author_id", F.concat("tweet_id", F.lit(".0")).alias("tweet_id"),
        F.concat("text", F.lit('\n"quoted", and more')).alias("text"),
        F.when(F.col("tweet_id") % 7 == 0, "n/a").otherwise(F.col("in_response_to_tweet_id").cast("string")).alias(
            "in_response_to_tweet_id"
        ),
    )
    tables.write_table(raw.repartition(3), folder, fmt="csv")
    return tables.read_tweets(spark, folder)


@query
def normalize_id(spark, sf):
    raw = F.concat("event_id", F.when(F.col("event_id") % 3 == 0, ".0").when(F.col("event_id") % 3 == 1, "").otherwise("x"))
    return frame(spark, sf, "events").select("event_id", text.normalize_id(raw).alias("id"))


@query
def thread_table(spark, sf):
    folder = shared_folder(spark, "threads")
    rows = frame(spark, sf, "threads_v").withColumn("thread_id", F.col("thread_id").cast("string"))
    tables.write_table(tables.require_columns(rows, schemas.THREADS.names), folder, fmt="csv")
    return tables.read_table(spark, folder, schemas.THREADS, "csv")


@query
def split_table(spark, sf):
    folder = shared_folder(spark, "split")
    tables.write_split(seeded.golden_split(frame(spark, sf, "threads_v"), GOLDEN), folder)
    return spark.read.parquet(folder).select("thread_id", "customer_text", "split")


@query
def result_table(spark, sf):
    """Two batches of results, one without judge columns, appended and read back."""
    folder = shared_folder(spark, "results")
    rows = frame(spark, sf, "golden_v").select(F.col("thread_id").cast("string").alias("thread_id"), "customer_text", "true_intent")
    for part in (rows.filter("cast(thread_id AS bigint) % 2 = 0"), rows.filter("cast(thread_id AS bigint) % 2 = 1")):
        tables.append_table(tables.add_missing(part, schemas.JUDGE_COLUMNS), folder)
    return tables.read_table(spark, folder, schemas.RESULTS).select("thread_id", "customer_text", "true_intent", "judge_tone")


@query
def summary_table(spark, sf):
    folder = shared_folder(spark, "summary")
    tables.write_summary(reports.baseline_report(frame(spark, sf, "eval_v")), folder)
    return spark.read.schema(schemas.SUMMARY).json(folder)


@query
def message_chunks(spark, sf):
    """Chunks of one scan, written one by one and read as one table."""
    folder = shared_folder(spark, "chunks")
    rows = frame(spark, sf, "messages_v")
    for i in range(3):
        tables.append_table(rows.filter(F.pmod("thread_id", F.lit(3)) == i), folder)
    return spark.read.parquet(folder)


# Streams, run to the end of their input.

def _rule_answers(messages):
    """Answers as a classifier would give them, from the keyword rules."""
    answer = F.to_json(
        F.struct(
            rules.keyword_intent("customer_text").alias("intent"),
            F.lit(0.9).alias("confidence_score"),
            rules.keyword_escalate("customer_text").alias("should_escalate"),
            F.lit("").alias("escalation_reason"),
        )
    )
    return messages.select(
        F.col("thread_id").alias("id"), answer.alias("answer"), F.lit(None).cast("string").alias("error")
    )


def _message_stream(spark, sf, folder, view="messages_v"):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    name = "casework_events_" + folder.rsplit("-", 1)[1]
    streams.read_stream(spark, path, schema).createOrReplaceTempView(name)
    base = {"events": f"SELECT * FROM {name}", "conversations": f"SELECT * FROM parquet.`{sf}/conversations.parquet`"}
    return spark.sql(with_views([view], f"SELECT * FROM {view}", base))


@query
def triage_stream(spark, sf):
    folder = shared_folder(spark, "triage")
    started = streams.triage_stream(
        _message_stream(spark, sf, folder), _rule_answers, f"{folder}/out", f"{folder}/state"
    )
    started.awaitTermination()
    decided = spark.read.parquet(f"{folder}/out/decisions").select("thread_id", "status")
    rejects = spark.read.parquet(f"{folder}/out/rejects").select(
        F.col("thread_id").cast("string").alias("thread_id"), F.col("message_status").alias("status")
    )
    return decided.unionByName(rejects)


@query
def evaluate_stream(spark, sf):
    folder = shared_folder(spark, "evaluate")
    for _ in range(2):  # the second run finds nothing new
        streams.evaluate_stream(
            _message_stream(spark, sf, folder, "golden_v"), _rule_answers, f"{folder}/out", f"{folder}/state"
        ).awaitTermination()
    rejects = spark.read.parquet(f"{folder}/out/rejects").select(
        "thread_id", F.col("reason").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in _EVALUATED.items()]
    ).distinct()  # what has no text stays open and is rejected by each run
    results = spark.read.parquet(f"{folder}/out/results")
    return results.select("thread_id", F.col("agent_status").alias("status"), *_EVALUATED).unionByName(rejects)


@query
def kb_stream(spark, sf):
    folder = shared_folder(spark, "kb")
    arriving = frame(spark, sf, "threads_v")
    arriving.write.parquet(f"{folder}/threads")
    streams.kb_stream(
        streams.read_stream(spark, f"{folder}/threads", arriving.schema),
        f"{folder}/out", f"{folder}/state",
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "document")


@query
def kb_stream_merged(spark, sf):
    """Threads delivered in parts and then all again, their directories merged between the runs."""
    folder = shared_folder(spark, "kb")
    arriving = frame(spark, sf, "threads_v")
    parts = [arriving.filter(F.pmod("thread_id", F.lit(3)) == i) for i in range(3)]
    for part in (*parts, arriving):
        part.write.mode("append").parquet(f"{folder}/threads")
        streams.kb_stream(
            streams.read_stream(spark, f"{folder}/threads", arriving.schema), f"{folder}/out", f"{folder}/state"
        ).awaitTermination()
        batches.merge(spark, f"{folder}/out", schemas.KNOWLEDGE_BASE, "id")
    batches.clean(spark, f"{folder}/out")
    return batches.read(spark, f"{folder}/out", schemas.KNOWLEDGE_BASE).select("id", "document")


@query
def label_stream(spark, sf):
    """A label log in several files, the last events first."""
    folder = shared_folder(spark, "labels")
    events = frame(spark, sf, "label_events_v")
    for i in (2, 1, 0):
        part = events.filter(F.pmod("seq", F.lit(3)) == i).repartitionByRange(2, F.desc("seq"))
        part.write.mode("append").parquet(f"{folder}/in")
        source = streams.read_stream(spark, f"{folder}/in", events.schema)
        label_streams.label_stream(source, f"{folder}/out", f"{folder}/state").awaitTermination()
    golden = events.select(F.col("thread_id").cast("string").alias("thread_id")).distinct()
    done = labels.apply_labels(golden, label_streams.current(spark, f"{folder}/out"))
    return done.withColumnRenamed("escalation_reason", "reason").withColumn("thread_id", F.col("thread_id").cast("bigint"))


@query
def growing_report(spark, sf):
    """The evaluation report after the last of several batches, from counts kept per batch."""
    folder = shared_folder(spark, "growing")
    results = frame(spark, sf, "eval_v")
    for i in range(3):
        part = results.filter(F.pmod("thread_id", F.lit(3)) == i)
        batches.write(part, f"{folder}/results", ("r", i), "thread_id")
        card = increments.card(spark, f"{folder}/results", f"{folder}/cards", results.schema)
    return reports.evaluation_report(None, card)


@query
def result_versions(spark, sf):
    """Results appended in two versions, a third one with their judgements."""
    folder = shared_folder(spark, "versions")
    results = frame(spark, sf, "eval_v")
    for i in range(2):
        versions.append(results.filter(F.pmod("thread_id", F.lit(2)) == i), folder)
    stored = versions.read(spark, folder, results.schema)
    unjudged = stored.filter(text.has_reply("drafted_reply") & F.col("judge_tone").isNull())
    scores = unjudged.select(
        "thread_id", (1 + F.length("drafted_reply") % 5).cast("int").alias("judge_tone"),
        (1 + F.length("customer_text") % 5).cast("int").alias("judge_grounding"),
    )
    versions.replace(triage.apply_judgements(stored, scores), folder, 2)
    return versions.read(spark, folder, results.schema).select("thread_id", "judge_tone", "judge_grounding")
