"""Registered queries of the operators, over whole tables with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from casework.llm import (
    ann, bpe, lexical, lm, merkle, minhash, mixing, order_minhash, pii, quality, rules, sharding, suffix,
)

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utf8(column):
    """Bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


@query
def op3_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = bpe.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op2_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op9_sharding(spark, sf):
    done = sharding.sharded(table(spark, sf, "documents"), [1.0] * 24, grown_weight=1.0)
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op6_rules(spark, sf):
    return rules.judged(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance",
    )


#: Key of the pseudonyms in the registered queries; a real one is the caller's secret.
PII_KEY = "registered-query"


@query
def op7_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY)


@query
def op8_ann(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query
def op10_minhash(spark, sf):
    return minhash.grouped(table(spark, sf, "documents"))


@query
def op5_lm(spark, sf):
    fold = quality.held_out("doc_id", 7)
    done = lm.scored(table(spark, sf, "documents"), ~fold)
    return done.withColumn("held_out", ~F.col("train")).drop("train")


@query
def op1_suffix(spark, sf):
    done = suffix.without_repeats(table(spark, sf, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


#: Weights of the registered mixture, by path; what isn't named weighs 1.
WEIGHTS = {
    ("web",): 5, ("books",): 3, ("other",): 2,
    ("web", "en"): 4, ("web", "de"): 2, ("web", "fr"): 2,
    ("books", "en"): 3, ("books", "fr"): 2,
}


def domain(source):
    """Domain of a source in the test tables, by its number."""
    number = F.regexp_extract(source, r"^src(\d+)$", 1)
    return (
        F.when(number.rlike(r"^\d$"), "web").when(number.rlike(r"^1[0-4]$"), "books").otherwise("other")
    )


@query
def op4_mixing(spark, sf):
    levels = {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    done = mixing.mixed(table(spark, sf, "documents"), levels, WEIGHTS, share=(3, 4), epochs=3)
    return done.select(
        "doc_id", "epoch", domain(F.col("source")).alias("domain"), "lang", "source",
        mixing.token_count("text").alias("tokens"),
    )


def _level(parents, own, weight):
    """One level of the tree in SQL: budgets of nodes from those of their parents."""
    path = [*parents, own]
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    inner = f"PARTITION BY {', '.join('n.' + c for c in parents)}" if parents else ""
    keys = ", ".join(path)
    return f"""
n{len(path)} AS (SELECT {keys}, sum(tokens) * 3 AS cap, {weight} AS w FROM leaves GROUP BY {keys}),
f{len(path)} AS (SELECT n.*, g.got AS budget,
  g.got - coalesce(sum(cap) OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
  sum(w) OVER ({inner}) - coalesce(sum(w) OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy
  FROM n{len(path)} n JOIN g{len(parents)} g ON {' AND '.join(f'n.{c} = g.{c}' for c in parents) or 'true'}
  WINDOW ord AS ({inner} ORDER BY cap / w, n.{own})),
o{len(path)} AS (SELECT *, cap * heavy <= remaining * w AS is_full FROM f{len(path)}),
r{len(path)} AS (SELECT *, CASE WHEN is_full THEN 0 ELSE w END AS open,
  budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({over}) AS rest FROM o{len(path)}),
u{len(path)} AS (SELECT *, sum(open) OVER ({over}) AS every,
  sum(open) OVER ({over} ORDER BY {own} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r{len(path)}),
g{len(path)} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE (rest * upto) // every - (rest * (upto - open)) // every END AS got
  FROM u{len(path)})"""


def _mixing_sql():
    def weights(depth, *names):
        cases = "".join(
            " WHEN " + " AND ".join(f"{n} = '{v}'" for n, v in zip(names, path)) + f" THEN {w}"
            for path, w in WEIGHTS.items() if len(path) == depth
        )
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    return f"""
WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
  CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books' ELSE 'other' END AS domain
  FROM documents),
s AS (SELECT * FROM d WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY ALL),
g0 AS (SELECT (sum(tokens) * 3) // 4 AS got FROM leaves),
{_level([], "domain", weights(1, "domain"))},
{_level(["domain"], "lang", weights(2, "domain", "lang"))},
{_level(["domain", "lang"], "source", weights(3))},
plan AS (SELECT domain, lang, source, got // tokens AS whole, got % tokens AS part FROM leaves JOIN g3 USING (domain, lang, source)),
ordered AS (SELECT s.*, whole, part, sum(s.tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('42:' || CAST(whole + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS upto
  FROM s JOIN plan USING (domain, lang, source)),
times AS (SELECT *, greatest(least(tokens, part - (upto - tokens)), 0) AS room FROM ordered),
e AS (SELECT *, unnest(range(1, CAST(whole + CASE WHEN room > 0 THEN 1 ELSE 0 END AS INT) + 1)) AS epoch FROM times)
SELECT doc_id, CAST(epoch AS INT) AS epoch, domain, lang, source, CAST(CASE WHEN epoch > whole THEN room ELSE tokens END AS BIGINT) AS tokens FROM e"""


ORACLE["op4_mixing"] = _mixing_sql()


@query
def op11_lexical(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)


def _lexical_sql():
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {found} AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS words FROM d WHERE len(terms) > 0),
m AS (SELECT doc_id, 75 + (25 * len(terms) * docs) // words AS m FROM d, s WHERE len(terms) > 0),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({found}) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20"""


ORACLE["op11_lexical"] = _lexical_sql()


@query
def op12_order_minhash(spark, sf):
    return order_minhash.compared(table(spark, sf, "documents"))


@query
def op13_merkle(spark, sf):
    docs = table(spark, sf, "documents")

    def leaf(n_chars):
        return merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang")], n_chars, F.col("text"))

    # One row in seven gets its length raised by one after the manifest was made.
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    raised = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    rows = docs.select(
        "doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(touched, leaf(raised)).alias("changed")
    )
    done = merkle.manifest(rows, "leaf", "doc_id", "lang")
    return done.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels=24):
    """The same by one grouping per level; ``levels`` suffice for 2 ** levels leaves of a language."""
    def framed(c):
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"

    def leaf(n_chars):
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
        return "sha256(" + " || ".join(framed(v) for v in values) + ")"

    def tree(prefix, start):
        out = [f"{prefix}0 AS ({start})"]
        for n in range(levels):
            out.append(
                f"{prefix}{n + 1} AS (SELECT g, i // 2 AS i, (any_value(size) + 1) // 2 AS size, "
                f"CASE WHEN any_value(size) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
                f"FROM {prefix}{n} GROUP BY g, i // 2)"
            )
        return out

    def climb(prefix, start):
        out = [f"{prefix}p0 AS ({start})"]
        for n in range(levels):
            out.append(
                f"{prefix}p{n + 1} AS (SELECT p.* REPLACE (p.i // 2 AS i, "
                f"CASE WHEN s.size > 1 THEN p.proof || coalesce(o.h, '') ELSE p.proof END AS proof, "
                f"CASE WHEN s.size = 1 THEN p.f WHEN p.i % 2 = 0 THEN sha256(p.f || coalesce(o.h, '')) ELSE sha256(o.h || p.f) END AS f) "
                f"FROM {prefix}p{n} p JOIN {prefix}{n} s ON p.g = s.g AND p.i = s.i "
                f"LEFT JOIN {prefix}{n} o ON p.g = o.g AND o.i = xor(p.i, 1))"
            )
        return out

    # Checksum of a few bytes, bit by bit.
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen({0}) + 1), "
        "lambda k: CAST(ascii({0}[k]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
        "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    ).format("CAST(doc_id AS VARCHAR)")
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf('n_chars')} AS leaf, "
        f"CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS changed FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n FROM d)",
        *tree("a", "SELECT g, n AS i, count(*) OVER (PARTITION BY g) AS size, leaf AS h FROM r"),
        f"k AS (SELECT g AS key, h, row_number() OVER (ORDER BY g) - 1 AS n FROM a{levels})",
        *tree("b", "SELECT '' AS g, n AS i, count(*) OVER () AS size, h FROM k"),
        *climb("a", "SELECT doc_id, leaf, g, n AS i, g AS key, '' AS proof, coalesce(changed, leaf) AS f FROM r"),
        *climb("b", f"SELECT p.* REPLACE ('' AS g, k.n AS i), k.h AS subroot FROM ap{levels} p JOIN k USING (key)"),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, b{levels}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{levels}.h AS verified
FROM bp{levels} JOIN b{levels} ON true"""


ORACLE["op13_merkle"] = _merkle_sql()
