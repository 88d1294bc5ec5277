"""The registered queries of this subpackage, one for each operator, and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossgraph.llm import collocations, langid, licenses, media, mixing, packing, pii, prefix_trie, quality, secrets, simhash, toxicity, urlfilter
from glossgraph.llm.common import cut, n_words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = tuple(
    urlfilter.Rule(verdict, text)
    for verdict, text in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rule or path template; null and odd addresses have an empty host and path.

    The tables label documents and not pages, so a page's label comes from its text, see README.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", langid.visible_text(F.col("html")).alias("visible"))
    # a page is labelled by its text: bad if symbols stand beside a good part of its words
    symbols = F.length("visible") - F.length(F.translate("visible", "#*$%|", ""))
    labelled = pages.select("page_id", "url", F.when(F.length("visible") > 0, (4 * symbols > n_words(F.col("visible"))).cast("int")).alias("bad"))
    return urlfilter.judge(labelled, RULES).select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements and failure bits, and the latest policy's verdict; null texts fail as empty ones do."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(quality.ledger(docs))
    measures = [F.col(f"ledger.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    bits = F.col("ledger.fail_bits")
    return judged.select(
        "doc_id",
        *measures,
        (bits.bitwiseAND(F.lit(quality.BASE).cast("long")) != 0).alias("base_failed"),
        "kept",
        bits.alias("fail_bits"),
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; null sources are one source, null texts have size 0."""
    docs = _table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    mixed = mixing.mix(sized, "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licences found in it, the best one and its Dice coefficient; none for null texts."""
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get("licenses", F.lit(0))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        best["license"].alias("license"),
        best["dice"].alias("dice"),
        best["passage"].alias("passage"),
        F.array_join(F.array_sort(F.transform("licenses", lambda x: x["license"])), ",").alias("licenses"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that links of at most three bits reach."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence; null texts have the separator alone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(cut(packing.pieces(docs, packing.tokenizer_path())))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a WAV file that was read back: digests, and its peak pairs as time codes and hashes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = media.with_media(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).drop("text")
    read = stored.withColumn("read", media.media_features(F.col("media")))
    pairs = F.array_join(F.zip_with("read.times", "read.hashes", lambda t, h: F.concat_ws(":", t.cast("string"), h.cast("string"))), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.col("read.n_samples").alias("payload_bytes"),
        "read.payload_sha256",
        "read.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("read.hashes").cast("string"), F.sha2(pairs, 256)).alias("feature"),
        "read.times",
        "read.hashes",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and page with its language and how sure it is; null texts go by their host and declaration."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    none = F.lit(None).cast("string")
    host, domain, suffix = langid.address(F.col("url"))
    # a document has no markup and no address; its source stands for the host
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), F.concat(F.lit("source:"), F.col("source")).alias("host"), none.alias("domain"), none.alias("suffix")).unionByName(
        pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", langid.visible_text(F.col("html")).alias("text"), langid.declared(F.col("html")).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    )
    return langid.identify(rows, model).select("doc_id", "page_id", "lang", "p", "text_lang", "declared", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity and grade, by a model of the documents that have labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").withColumn("grade", toxicity.given_grade())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", "toxicity.severity", "toxicity.p_toxic", "toxicity.grade", F.col("toxicity.rejected").alias("toxic"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data; null texts have none."""
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k.name) for k in pii.BASE_KINDS),
        F.sha2(pii.digest(F.col("pii"), pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.digest(F.col("pii")).alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that begin with turns of others; rows without conv_id are left out."""
    return prefix_trie.prefix_trie(*prefix_trie.borrowed(prefix_trie.numbered(_table(spark, sf_dir, "conversations"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of secrets; null texts have none."""
    found = secrets.find(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    names = [k.name for k in secrets.BASE_KINDS]
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, [*names, secrets.ENTROPY]),
        F.sha2(secrets.digest(F.col("secrets"), tuple(names)), 256).alias("base_sha256"),
        secrets.digest(F.col("secrets")).alias("spans"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents; null texts have none."""
    return collocations.mine(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_media_columns": op7_media_columns,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_secret_scan": op12_secret_scan,
    "op13_collocations": op13_collocations,
}
OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), turns AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + (turn - 1) % 3] AS DOUBLE) AS weight, 2.0 * source_size AS lim
  FROM (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn
        FROM sized GROUP BY source)
), levels AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM turns)
             - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM turns
), targets AS (
  SELECT source, source_size, least(lim, weight * (SELECT arg_min(level, lim / weight) FROM levels WHERE lim >= level * weight)) AS target
  FROM levels
), marked AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CAST(round(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * 4294967296) AS HUGEINT) AS units,
         bin(s.size + 1) AS bits,
         CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h,
         CAST('0x' || substr(md5('0:' || coalesce(s.source, '')), 1, 8) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, start + sum(units) OVER (PARTITION BY source ORDER BY lpad(CAST(length(bits) AS VARCHAR), 2, '0') || rpad(substr(bits, 2, 3), 3, '0'),
                                     h % 128, size, h, doc_id ROWS UNBOUNDED PRECEDING) AS last
  FROM marked
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (last // 4294967296 - (last - units) // 4294967296) AS BIGINT) AS taken
FROM summed
"""
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
  FROM w LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
            + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
            + CASE WHEN 100 * n_upper > 60 * word_chars THEN 16 ELSE 0 END + CASE WHEN 100 * n_marks > 40 * n_words THEN 32 ELSE 0 END
            + CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END AS b
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b % 4 <> 0 AS base_failed, b = 0 AS kept, CAST(b AS BIGINT) AS fail_bits FROM bits
"""
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Windows are counted anew one by one here, and spans placed by sums over all pieces before them.
OP12_SQL = rf"""
WITH kinds(kind, rank, pattern, part, least) AS (
  VALUES {", ".join(f"({_quoted(k.name)}, {n}, {_quoted(k.pattern.replace('++', '+').replace('}+', '}').replace('?+', '?').replace('*+', '*'))}, {k.group}, {k.least})" for n, k in enumerate((*secrets.BASE_KINDS, secrets.Base(secrets.ENTROPY, secrets.CANDIDATE, 0, secrets.WINDOW, ""))))}
), classes(letters, most) AS (VALUES {", ".join(f"({_quoted(k.characters)}, {k.most})" for k in secrets.CLASSES)}),
found AS (
  SELECT doc_id, kind, rank, least, regexp_extract_all(coalesce(text, ''), pattern) AS m, CASE part WHEN 1 THEN regexp_extract_all(coalesce(text, ''), pattern, 1) ELSE regexp_extract_all(coalesce(text, ''), pattern) END AS g,
         string_split_regex(coalesce(text, ''), pattern) AS pieces
  FROM documents, kinds
), placed AS (
  SELECT doc_id, kind, rank, least, m[i] AS x, g[i] AS part, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)
), candidates AS (
  SELECT DISTINCT x FROM placed WHERE kind = {_quoted(secrets.ENTROPY)} AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, {_quoted("|".join(f"(?:{a})" for a in secrets.ALLOWED))})
), windows AS (
  SELECT x, letters, most, string_split(substr(x, i, {secrets.WINDOW}), '') AS w
  FROM (SELECT x, unnest(range(1, length(x) - {secrets.WINDOW} + 2)) AS i FROM candidates), classes
), telling AS (
  SELECT DISTINCT x FROM windows
  WHERE len(list_filter(w, lambda c: strpos(letters, c) = 0)) = 0
    AND list_sum(list_transform(list_distinct(w), lambda c: ({list(secrets.SURPRISE)})[1 + len(list_filter(w, lambda d: d = c))])) <= most
), spans AS (
  SELECT doc_id, kind, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(x) AS BIGINT) AS span
  FROM placed WHERE CASE WHEN kind = {_quoted(secrets.ENTROPY)} THEN x IN (SELECT x FROM telling) ELSE length(part) >= least END
), summed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)
"""
OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), parted AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM parted, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE len(ws) >= k),
counted AS (SELECT lang, k, ws[i:i + k - 1] AS ws, count(*) AS n FROM places GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE n >= 30),
cuts AS (SELECT lang, ws, n AS a, unnest(range(1, k)) AS c FROM often WHERE k > 1),
priced AS (
  SELECT cuts.lang, cuts.ws, a, c, x.n AS l, y.n AS r, (CAST(2000000 AS HUGEINT) * a) // (x.n + y.n) AS score
  FROM cuts JOIN often x ON x.lang = cuts.lang AND x.ws = cuts.ws[1:c] JOIN often y ON y.lang = cuts.lang AND y.ws = cuts.ws[c + 1:]
), lowest AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, c) = 1),
inner_phrases AS (
  SELECT lang, ws[i:i + m - 1] AS ws, n FROM (SELECT lang, ws, k, m, n, unnest(range(1, k - m + 2)) AS i FROM often, (VALUES (2), (3)) AS shorter(m) WHERE k > m)
), covering AS (SELECT lang, ws, max(n) AS n FROM inner_phrases GROUP BY ALL),
free AS (
  SELECT lowest.*, array_to_string(lowest.ws, ' ') AS phrase FROM lowest LEFT JOIN covering ON covering.lang = lowest.lang AND covering.ws = lowest.ws
  WHERE covering.n IS NULL OR CAST(100 AS HUGEINT) * covering.n < CAST(80 AS HUGEINT) * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
#: A node is known by the joined digests of its turns; CRC-32 is computed bit by bit.
OP11_SQL = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, count(*) AS own FROM ordered GROUP BY conv_id),
bits AS (
  SELECT conv_id, own, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)) AS crc
  FROM sizes
), plan AS (SELECT bits.conv_id, bits.own, xor(crc, 4294967295) % 9 AS h, bits.conv_id - bits.conv_id % 5 AS base FROM bits),
full_plan AS (SELECT plan.*, least(h, coalesce(sizes.own, 0)) AS k FROM plan LEFT JOIN sizes ON sizes.conv_id = plan.base),
turns AS (
  SELECT p.conv_id, pos, role, text FROM full_plan p JOIN ordered o ON o.conv_id = p.base WHERE pos <= h
  UNION ALL
  SELECT p.conv_id, pos - h + k, role, text FROM full_plan p JOIN ordered o ON o.conv_id = p.conv_id WHERE pos > h
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, CAST(0 AS BIGINT) AS bytes FROM full_plan
  UNION ALL
  SELECT conv_id, CAST(pos AS BIGINT), string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos), octet_length(encode(text)) FROM turns
), lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, CASE WHEN depth > 0 THEN left(node, 32 * (depth - 1)) END AS parent FROM paths GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (
  SELECT p.node, sum((u.n_convs - 1) * u.bytes) AS saved, count(*) FILTER (u.node NOT IN (SELECT node FROM children)) AS leaves
  FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node
), ends AS (
  SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN lengths l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY p.node
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN above a ON a.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
ORACLES: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_collocations": OP13_SQL, "op2_quality_rules": OP2_SQL, "op3_source_mixing": OP3_SQL}
