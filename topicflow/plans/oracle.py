"""The registered queries restated in SQL (DuckDB dialect) over the same tables.

Written from the definitions of the operators, not from their Spark plans: joins and
grouping by document where Spark works within the row, for instance.
"""

from __future__ import annotations

from topicflow.functions.prompts import SUMMARY_TEMPLATE, TEMPLATES, TOPIC_TEMPLATE
from topicflow.functions.words import STOP_WORDS

TOPICS = ("thanedble", "thintion", "theaeati", "worthless", "pathetic", "disgusting", "tion the", "zzqx")
STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = "[a-z0-9_]{2,}"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _clean(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '[^\\x20-\\x7E]+', '', 'g'), ' +', ' ', 'g'))"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


def _mentions(body: str, topic: str) -> str:
    return f"((length({body}) - length(replace({body}, {topic}, ''))) // length({topic}))"


YEAR = "CAST(2020 + (doc_id // 20) % 5 AS INTEGER)"
VENUE = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' ELSE upper(lang) END"

PAPERS = f"""
papers AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id,
         {_clean("split_part(text, chr(10), 1)")} AS title, {_clean("text")} AS abstract,
         CASE WHEN quality = 1 THEN {_clean("split_part(text, chr(10), -1)")} END AS summary,
         {YEAR} AS year, source || '_' || {YEAR} AS conference, {VENUE} AS venue, lang, source, quality
  FROM documents LEFT JOIN labels USING (doc_id)),
bodies AS (
  SELECT paper_id, year, lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(summary, '')) AS body
  FROM papers)"""

VALUES_TOPICS = ", ".join(f"({i}, {_quote(t)})" for i, t in enumerate(TOPICS, 1))

FLAT = f"""
flat AS (
  SELECT conference, paper_id, paper_id AS forum, CAST(doc_id AS INTEGER) AS number,
         CASE WHEN quality = 1 THEN summary ELSE '' END AS tldr, title, abstract, source AS authors,
         lang || '|' || source AS keywords, venue,
         CASE WHEN doc_id % 2 = 0 THEN CASE quality WHEN 1 THEN 'Accept' WHEN 0 THEN 'Reject' END END AS decision,
         doc_id % 2 = 0 AS has_decision
  FROM papers)"""


def _tfidf(name: str, where: str, n: int) -> str:
    """CTEs ending in ``<name>`` (rank, topic, score): the top terms of the selected bodies."""
    return f"""
{name}_docs AS (SELECT paper_id, body FROM bodies WHERE {where}),
{name}_tokens AS (
  SELECT paper_id, list_filter(regexp_extract_all(body, '{WORDS}'), lambda w: w NOT IN ({STOP_LIST})) AS words
  FROM {name}_docs),
{name}_grams AS (
  SELECT paper_id, unnest(words) AS term FROM {name}_tokens
  UNION ALL
  SELECT paper_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
  FROM {name}_tokens WHERE len(words) >= 2),
{name}_tf AS (SELECT paper_id, term, count(*) AS tf FROM {name}_grams GROUP BY ALL),
{name}_terms AS (
  SELECT term, sum(tf) AS occurrences, count(*) AS documents FROM {name}_tf
  GROUP BY term HAVING count(*) >= 2 ORDER BY occurrences DESC, term LIMIT 1000),
{name}_weights AS (
  SELECT paper_id, term, tf * (ln((1.0 + (SELECT count(*) FROM {name}_docs)) / (1.0 + documents)) + 1) AS w
  FROM {name}_tf JOIN {name}_terms USING (term)),
{name}_norms AS (SELECT paper_id, sqrt(sum(w * w)) AS norm FROM {name}_weights GROUP BY paper_id),
{name}_scores AS (
  SELECT term AS topic, sum(w / norm) AS score FROM {name}_weights JOIN {name}_norms USING (paper_id) GROUP BY term),
{name} AS (
  SELECT CAST(row_number() OVER (ORDER BY round(score, 6) DESC, topic) AS INTEGER) AS rank, topic, score
  FROM {name}_scores ORDER BY rank LIMIT {n})"""


def _trends(topics: str, where: str = "TRUE") -> str:
    return f"""
trends AS (
  SELECT rank, topic, year, CAST(sum({_mentions("body", "topic")}) AS BIGINT) AS mentions,
         count(*) FILTER (WHERE contains(body, topic)) AS papers_with_topic, count(*) AS papers
  FROM {topics} CROSS JOIN bodies WHERE {where} GROUP BY rank, topic, year)"""


EMERGING = f"""{_tfidf("recent", "year IN (2023, 2024)", 20)},{_tfidf("earlier", "year IN (2020, 2021)", 20)},
frequencies AS (
  SELECT rank, topic,
         sum(CASE WHEN year IN (2023, 2024) THEN {_mentions("body", "topic")} ELSE 0 END) AS r,
         sum(CASE WHEN year IN (2020, 2021) THEN {_mentions("body", "topic")} ELSE 0 END) AS c,
         count(*) FILTER (WHERE year IN (2023, 2024)) AS nr, count(*) FILTER (WHERE year IN (2020, 2021)) AS nc
  FROM recent CROSS JOIN bodies GROUP BY rank, topic),
rates AS (
  SELECT rank, topic, CAST(r AS DOUBLE) / nr AS recent_frequency,
         CASE WHEN topic IN (SELECT topic FROM earlier) THEN CAST(c AS DOUBLE) / nc ELSE 0.0 END AS comparison_frequency,
         c > 0 AS seen_before, nr AS total_recent_papers, nc AS total_comparison_papers
  FROM frequencies),
emerging AS (
  SELECT *, CASE WHEN comparison_frequency > 0 THEN (recent_frequency - comparison_frequency) / comparison_frequency
                 ELSE recent_frequency END AS growth_rate, comparison_frequency = 0 AS is_new
  FROM rates
  WHERE CASE WHEN comparison_frequency > 0 THEN (recent_frequency - comparison_frequency) / comparison_frequency
             ELSE recent_frequency END >= 0.1),
fastest AS (
  SELECT CAST(row_number() OVER (ORDER BY growth_rate DESC, rank) AS INTEGER) AS position, topic, growth_rate,
         CASE WHEN is_new THEN 'NEW' ELSE 'GROWING' END AS status
  FROM emerging ORDER BY position LIMIT 10)"""

NETWORK = f"""{_tfidf("themes", "year = 2024", 30)},
occurrences AS (
  SELECT topic, paper_id FROM themes JOIN bodies ON year = 2024 AND contains(body, topic)),
edges AS (
  SELECT a.topic AS topic1, b.topic AS topic2, count(*) AS cooccurrence
  FROM occurrences a JOIN occurrences b ON a.paper_id = b.paper_id AND a.topic <> b.topic
  GROUP BY ALL HAVING count(*) >= 2),
nodes AS (
  SELECT rank, topic, (SELECT count(*) FROM occurrences o WHERE o.topic = t.topic) AS papers,
         (SELECT count(*) FROM edges e WHERE e.topic1 = t.topic) AS centrality
  FROM themes t)"""

VECTORS = """
vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS paper_id, CAST(2020 + (vec_id // 20) % 5 AS INTEGER) AS year, label,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""


def _means(keys: str, query_id: str) -> str:
    return f"""
cells AS (SELECT {keys}, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM vectors),
means AS (SELECT {keys}, pos, avg(x) AS x FROM cells GROUP BY {keys}, pos),
queries AS (SELECT {query_id} AS query_id, {keys}, list(x ORDER BY pos) AS q FROM means GROUP BY {keys})"""


def _nearest(condition: str) -> str:
    return f"""
pairs AS (
  SELECT query_id, paper_id, 1 - list_cosine_similarity(q, embedding) AS d
  FROM queries JOIN vectors v ON {condition}),
matches AS (
  SELECT query_id, paper_id, round(d, 6) AS distance, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY round(d, 6), paper_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= 5)"""


BY_LABEL = f"{VECTORS},{_means('label', 'CAST(label AS VARCHAR)')},{_nearest('TRUE')}"


def _by_label_year(shift: int) -> str:
    condition = f"v.year = queries.year + {shift}"
    return f"{VECTORS},{_means('label, year', "label || '-' || year")},{_nearest(condition)}"


QUESTIONS = f"""
asked AS (
  SELECT conv_id || '-' || turn AS question_id,
         {_clean("text")} || CASE conv_id % 3 WHEN 0 THEN ' in ' WHEN 1 THEN ' since ' ELSE ' before ' END
         || (2020 + conv_id % 5) AS question
  FROM conversations WHERE role = 'user')"""

BREAKS = "\\b(?:" + "|".join(STOP_WORDS) + "|(?:19|20)\\d{2}|[a-z0-9_])\\b|[^a-z0-9_\\- ]+"

PARSED = f"""{QUESTIONS},
with_years AS (
  SELECT *, list_transform(regexp_extract_all(question, '(?:19|20)\\d{{2}}'), lambda y: CAST(y AS INTEGER)) AS ys,
         lower(question) AS ql
  FROM asked),
with_kind AS (
  SELECT *, CASE
      WHEN (regexp_matches(ql, '\\bto\\b') OR regexp_matches(ql, '\\bbetween\\b.*\\band\\b')
            OR regexp_matches(ql, '\\d{{4}}\\s*-\\s*\\d{{4}}')) AND len(ys) >= 2 THEN 'range'
      WHEN regexp_matches(ql, '\\b(since|after)\\b') THEN CASE WHEN len(ys) > 0 THEN 'from' END
      WHEN regexp_matches(ql, '\\b(before|until)\\b') THEN CASE WHEN len(ys) > 0 THEN 'to' END
      WHEN len(ys) > 0 THEN 'exact' END AS kind
  FROM with_years),
phrases AS (
  SELECT question_id, list_transform(string_split(regexp_replace(ql, {_quote(BREAKS)}, '|', 'g'), '|'), lambda p: trim(p)) AS ps
  FROM with_kind),
hints AS (
  SELECT question_id, list_reduce(ps, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS hint FROM phrases),
parsed AS (
  SELECT question_id, question, array_to_string(ys, '|') AS years,
         CASE WHEN kind = 'exact' THEN ys[1] END AS year_exact,
         CASE WHEN kind = 'range' THEN list_min(ys) WHEN kind = 'from' THEN ys[1] END AS year_from,
         CASE WHEN kind = 'range' THEN list_max(ys) WHEN kind = 'to' THEN ys[1] END AS year_to,
         CASE WHEN hint <> '' THEN hint ELSE ql END AS topic_hint
  FROM with_kind JOIN hints USING (question_id))"""


def _buckets(text: str, key: str, source: str) -> str:
    """Word counts per hash bucket of a text column."""
    return f"""
  SELECT {key}, bucket, count(*) AS n FROM (
    SELECT {key}, CAST(('0x' || md5(w)[1:7]) AS BIGINT) % 256 AS bucket FROM (
      SELECT {key}, unnest(list_filter(regexp_extract_all(lower({text}), '{WORDS}'), lambda w: w NOT IN ({STOP_LIST}))) AS w
      FROM {source}))
  GROUP BY {key}, bucket"""


RETRIEVED = f"""{PAPERS},{PARSED},
distinct_questions AS (SELECT DISTINCT question, year_exact, year_from, year_to, topic_hint FROM parsed),
paper_counts AS ({_buckets("abstract", "paper_id", "papers")}),
question_counts AS ({_buckets("topic_hint", "question", "distinct_questions")}),
paper_norms AS (SELECT paper_id, sqrt(sum(n * n)) AS norm FROM paper_counts GROUP BY paper_id),
question_norms AS (SELECT question, sqrt(sum(n * n)) AS norm FROM question_counts GROUP BY question),
dots AS (
  SELECT question, paper_id, sum(q.n * p.n) AS dot
  FROM question_counts q JOIN paper_counts p USING (bucket) GROUP BY question, paper_id),
pairs AS (
  SELECT question, paper_id, 1 - coalesce(dot, 0) / (qn.norm * pn.norm) AS d
  FROM question_norms qn CROSS JOIN paper_norms pn LEFT JOIN dots USING (question, paper_id)
  JOIN papers USING (paper_id) JOIN distinct_questions q USING (question)
  WHERE (year_exact IS NULL OR year = year_exact) AND (year_from IS NULL OR year >= year_from)
    AND (year_to IS NULL OR year <= year_to)),
matches AS (
  SELECT question, paper_id, round(d, 6) AS distance, CAST(row_number() OVER (
           PARTITION BY question ORDER BY round(d, 6), paper_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= 5),
question_texts AS (
  SELECT question, string_agg(abstract, ' ' ORDER BY rank) AS context
  FROM matches JOIN papers USING (paper_id) GROUP BY question)"""

PENDING = """
pending AS (
  SELECT * FROM papers WHERE abstract <> '' AND coalesce(summary, '') = ''
    AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

RESPONSES = """
responses AS (
  SELECT conv_id || '-' || turn AS response_id,
         CASE role WHEN 'assistant' THEN '<think>' || role || '</think> - ' || text
                   WHEN 'user' THEN '<think>' || text ELSE '* ' || text END AS response
  FROM conversations)"""

ANSWER = _strip(
    "replace(replace(CASE WHEN contains(response, '<think>') AND contains(response, '</think>') "
    "THEN string_split(response, '</think>')[-1] ELSE response END, '<think>', ''), '</think>', '')"
)


def _extract(source: str) -> str:
    """Best three sentences of each abstract of a relation, weighted by the corpus words."""
    kept = f"lambda w: w NOT IN ({STOP_LIST})"
    return f"""
corpus AS (SELECT paper_id, unnest(list_filter(regexp_extract_all(body, '{WORDS}'), {kept})) AS topic FROM bodies),
weights AS (
  SELECT topic, CAST(round(ln(1 + count(*)) * 1000000) AS BIGINT) AS weight FROM corpus
  GROUP BY topic HAVING count(DISTINCT paper_id) >= 2),
sentences AS (
  SELECT paper_id, pos, trim(s) AS sentence FROM (
    SELECT paper_id, unnest(regexp_extract_all(abstract, '[^.!?]+[.!?]*')) AS s,
           unnest(range(len(regexp_extract_all(abstract, '[^.!?]+[.!?]*')))) AS pos FROM {source})
  WHERE trim(s) <> ''),
sentence_words AS (
  SELECT paper_id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '{WORDS}'), {kept})) AS topic FROM sentences),
sentence_weights AS (
  SELECT paper_id, pos, CAST(sum(coalesce(weight, 0)) AS BIGINT) * 1000 // count(*) AS weight
  FROM sentence_words LEFT JOIN weights USING (topic) GROUP BY paper_id, pos),
chosen AS (
  SELECT paper_id, pos, sentence FROM sentences LEFT JOIN sentence_weights USING (paper_id, pos)
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(weight, 0) DESC, pos) <= 3),
extracts AS (SELECT paper_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM chosen GROUP BY paper_id)"""


def _fact(section: str, item: str, detail: str, value: str, source: str) -> str:
    return (
        f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, CAST({detail} AS VARCHAR) AS detail, "
        f"round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"
    )


YEAR_COUNTS = "year_counts AS (SELECT year, count(*) AS papers FROM papers GROUP BY year)"
REPORT = f"{PAPERS},{_tfidf('keys', 'TRUE', 15)},{_trends('keys')},{EMERGING},{NETWORK},{YEAR_COUNTS}"
FACTS = "\nUNION ALL\n".join(
    [
        _fact("papers_per_year", "year", "''", "papers", "year_counts"),
        _fact("key_topics", "topic", "''", "rank", "keys"),
        _fact("trend_mentions", "topic", "year", "mentions", "trends"),
        _fact("trend_percentage", "topic", "year", "CAST(mentions AS DOUBLE) / papers * 100", "trends"),
        _fact("emerging_growth", "topic", "CASE WHEN is_new THEN 'NEW' ELSE 'GROWING' END", "growth_rate", "emerging"),
        _fact("topic_frequency", "topic", "''", "papers", "nodes"),
        _fact("centrality", "topic", "''", "centrality", "nodes"),
        _fact("cooccurrence", "topic1", "topic2", "cooccurrence", "edges"),
    ]
)
LINES = """SELECT 0 AS section, 0 AS line_no, 'papers from 2020 to 2024 | ' || count(*) AS line FROM papers
UNION ALL SELECT 1, year, 'papers in ' || year || ' | ' || papers FROM year_counts
UNION ALL SELECT 2, rank, 'topic ' || rank || ' | ' || topic FROM keys WHERE rank <= 10
UNION ALL SELECT 3, position,
  'rising ' || position || ' | ' || topic || ' | ' || printf('%+.1f', growth_rate * 100) || ' % | ' || lower(status) FROM fastest"""

TEMPLATE_ROWS = ", ".join(
    f"({_quote(k)}, {_quote(v.replace('{domain}', 'machine learning'))})" for k, v in TEMPLATES.items()
)
TOPIC_PROMPTS = f"""
sized AS (SELECT CAST(greatest(1, ceil(sum(length(body)) / (4000 * 64.0))) AS BIGINT) AS n FROM bodies),
pieces AS (
  SELECT paper_id AS key, CAST('0x' || substr(md5(paper_id), 1, 8) AS BIGINT) % n AS bucket, s AS start, substr(body, s + 1, 4000) AS piece
  FROM (SELECT *, unnest(range(0, greatest(length(body), 1), 4000)) AS s FROM bodies), sized),
placed AS (
  SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY bucket ORDER BY key, start
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 4000 AS chunk
  FROM pieces),
prompts AS (
  SELECT bucket || '-' || chunk AS prompt_id,
         replace({_quote(TOPIC_TEMPLATE.replace("{n}", "15"))}, '{{texts}}', string_agg(piece, chr(10) ORDER BY key, start)) AS prompt
  FROM placed GROUP BY bucket, chunk)"""

DIGEST = "length(abstract) || ' ' || md5(abstract)"

TRENDS_OF_TOPICS = f"""WITH {PAPERS}, keys(rank, topic) AS (VALUES {VALUES_TOPICS}),{_trends("keys")}
        SELECT topic, year, mentions, papers_with_topic, papers, round(CAST(mentions AS DOUBLE) / papers * 100, 6) AS percentage
        FROM trends"""

APPLIED = f"""WITH {PAPERS},
    newest AS (
      SELECT CAST(conv_id AS VARCHAR) AS paper_id, {_clean("text")} AS fresh FROM conversations
      WHERE role = 'assistant' AND {_clean("text")} <> ''
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, fresh DESC) = 1)
    SELECT paper_id, year, coalesce(fresh, summary) AS summary FROM papers LEFT JOIN newest USING (paper_id)"""

ORACLE_SQL = {
    "topic_trends": TRENDS_OF_TOPICS,
    "topic_trends_many": f"""WITH {PAPERS}, first(a) AS (SELECT unnest(string_split('aeiou', ''))), second(b) AS (SELECT unnest(string_split('lmnprstvdc', ''))),
        third(c) AS (SELECT unnest(string_split('aeiounrstl', ''))), keys(topic) AS (SELECT a || b || c FROM first, second, third)
        SELECT topic, year, CAST(sum({_mentions("body", "topic")}) AS BIGINT) AS mentions,
               count(*) FILTER (WHERE contains(body, topic)) AS papers_with_topic, count(*) AS papers
        FROM bodies, keys WHERE year BETWEEN 2020 AND 2024 GROUP BY topic, year""",
    "topic_trends_repeated": TRENDS_OF_TOPICS,
    "clean_documents": f"WITH {PAPERS} SELECT paper_id, title, abstract, summary FROM papers",
    "flatten_notes": f"WITH {PAPERS},{FLAT} SELECT * FROM flat WHERE title <> '' AND abstract <> ''",
    "schema_profile": f"""WITH {PAPERS}, kinds AS (
          SELECT conference, key, count(*) AS notes, min(doc_id % 2) AS low, max(doc_id % 2) AS high,
                 CASE WHEN key IN ('authors', 'keywords') THEN 'ARRAY<STRING>' WHEN key = 'venue' AND count(venue) = 0 THEN 'VOID' ELSE 'STRING' END AS kind
          FROM papers CROSS JOIN (VALUES ('title'), ('abstract'), ('TL;DR'), ('authors'), ('keywords'), ('venue')) k(key) GROUP BY conference, key)
        SELECT conference, key, notes, CASE WHEN low <> high THEN 'VARIANT' WHEN low = 0 THEN kind ELSE 'OBJECT<value: ' || kind || '>' END AS value_type
        FROM kinds""",
    "merge_decisions": f"""WITH {PAPERS}
        SELECT paper_id AS forum, conference, paper_id,
               CASE quality WHEN 1 THEN 'Accept' WHEN 0 THEN 'Reject' END AS decision
        FROM papers""",
    "decision_coverage": f"""WITH {PAPERS},{FLAT}
        SELECT conference, count(*) AS submissions, count(decision) AS with_decision,
               round(CAST(count(decision) AS DOUBLE) / count(*) * 100, 6) AS percentage,
               bool_and(has_decision) AS decisions_available
        FROM flat GROUP BY conference""",
    "missing_fields": f"""WITH {PAPERS},{FLAT}
        SELECT conference, count(*) FILTER (WHERE title = '') AS missing_title,
               count(*) FILTER (WHERE abstract = '') AS missing_abstract, count(*) FILTER (WHERE tldr = '') AS missing_tldr
        FROM flat GROUP BY conference""",
    "venue_histogram": f"""WITH {PAPERS},{FLAT}
        SELECT conference, lower(venue) AS venue, count(*) AS papers, FALSE AS is_empty FROM flat
        WHERE trim(coalesce(venue, '')) <> '' GROUP BY ALL
        UNION ALL
        SELECT conference, '<empty venue>', count(*) FILTER (WHERE trim(coalesce(venue, '')) = ''), TRUE
        FROM flat GROUP BY conference""",
    "papers_load": f"""WITH {PAPERS},{FLAT}
        SELECT paper_id, title, abstract, conference, coalesce(venue, 'unknown') AS venue, keywords,
               CAST(right(conference, 4) AS INTEGER) AS year
        FROM flat WHERE title <> '' AND abstract <> ''""",
    "papers_of_year": f"WITH {PAPERS} SELECT paper_id, title, abstract, summary, year, venue FROM papers WHERE year = 2023",
    "papers_of_year_limited": f"""WITH {PAPERS}
        SELECT paper_id, year, title, venue FROM papers
        QUALIFY row_number() OVER (PARTITION BY year ORDER BY paper_id) <= 25""",
    "papers_of_repeated_years": f"""WITH {PAPERS}
        SELECT paper_id, year, title FROM papers JOIN (VALUES (2023), (2024), (2024)) y(wanted) ON year = wanted""",
    "papers_per_year": f"""SELECT CAST(y AS INTEGER) AS year, count(doc_id) AS papers
        FROM range(2019, 2026) r(y) LEFT JOIN documents ON {YEAR} = y GROUP BY y""",
    "total_papers": "SELECT count(*) AS total_papers FROM documents",
    "term_statistics": f"""WITH {PAPERS},{_tfidf("keys", "TRUE", 15)}
        SELECT term, CAST(occurrences AS BIGINT) AS occurrences, documents FROM keys_terms""",
    "top_terms_tfidf": f"WITH {PAPERS},{_tfidf('keys', 'TRUE', 15)} SELECT rank, topic, round(score, 6) AS score FROM keys",
    "emerging_topics": f"""WITH {PAPERS},{EMERGING}
        SELECT rank, topic, round(recent_frequency, 6) AS recent_frequency,
               round(comparison_frequency, 6) AS comparison_frequency, seen_before, total_recent_papers,
               total_comparison_papers, round(growth_rate, 6) AS growth_rate, is_new
        FROM emerging""",
    "chart_emerging": f"""WITH {PAPERS},{EMERGING}
        SELECT position, topic, round(growth_rate, 6) AS growth_rate, status FROM fastest""",
    "chart_topic_trends": f"""WITH {PAPERS},{_tfidf("keys", "TRUE", 15)},{_trends("keys", "rank <= 5")}
        SELECT topic, year, round(CAST(mentions AS DOUBLE) / papers * 100, 6) AS percentage FROM trends""",
    "topic_document_frequency": f"""WITH {PAPERS}, keys(rank, topic) AS (VALUES {VALUES_TOPICS})
        SELECT topic, count(paper_id) AS papers FROM keys LEFT JOIN bodies ON contains(body, topic) GROUP BY topic""",
    "topic_cooccurrence": f"WITH {PAPERS},{NETWORK} SELECT topic1, topic2, cooccurrence FROM edges",
    "topic_centrality": f"WITH {PAPERS},{NETWORK} SELECT rank, topic, papers, centrality FROM nodes",
    "chart_centrality": f"""WITH {PAPERS},{NETWORK}
        SELECT topic, centrality FROM nodes ORDER BY centrality DESC, rank LIMIT 10""",
    "knn_exact": f"WITH {BY_LABEL} SELECT query_id, rank, paper_id, distance FROM matches",
    "knn_year_filtered": f"WITH {_by_label_year(0)} SELECT query_id, rank, paper_id, distance FROM matches",
    "knn_batch": f"""WITH {_by_label_year(3)}
        SELECT query_id, coalesce(string_agg(paper_id, '|' ORDER BY rank), '') AS papers
        FROM queries LEFT JOIN matches USING (query_id) GROUP BY query_id""",
    "knn_titles": f"""WITH {PAPERS},{BY_LABEL}
        SELECT query_id, rank, title, year FROM matches JOIN papers USING (paper_id)""",
    "knn_cells": f"WITH {BY_LABEL} SELECT query_id, rank, paper_id, distance FROM matches",
    "knn_many_queries": f"""WITH {VECTORS},
        queries AS (SELECT paper_id AS query_id, embedding AS q FROM vectors),{_nearest("TRUE")}
        SELECT query_id, rank, paper_id, distance FROM matches WHERE rank <= 3""",
    "embed_hashing": f"""WITH {PAPERS}, counts AS ({_buckets("abstract", "paper_id", "papers")})
        SELECT paper_id, CAST(bucket AS INTEGER) AS bucket, n AS count FROM counts""",
    "parsed_questions": f"WITH {PARSED} SELECT * FROM parsed",
    "parsed_questions_reference": f"""WITH {QUESTIONS},
        centuries AS (
          SELECT *, list_transform(regexp_extract_all(question, '(19|20)\\d{{2}}', 1), lambda y: CAST(y AS INTEGER)) AS cs
          FROM asked)
        SELECT question_id,
          CASE WHEN kind = 'exact' THEN cs[1] END AS year_exact,
          CASE kind WHEN 'range' THEN list_min(cs) WHEN 'from' THEN cs[1] END AS year_from,
          CASE kind WHEN 'range' THEN list_max(cs) WHEN 'to' THEN cs[1] END AS year_to
        FROM (SELECT *, CASE
            WHEN contains(question, 'to') OR contains(question, '-') THEN CASE WHEN len(cs) >= 2 THEN 'range' END
            WHEN contains(question, 'since') OR contains(question, 'after') THEN CASE WHEN len(cs) > 0 THEN 'from' END
            WHEN contains(question, 'before') OR contains(question, 'until') THEN CASE WHEN len(cs) > 0 THEN 'to' END
            WHEN len(cs) > 0 THEN 'exact' END AS kind FROM centuries)""",
    "retrieved_by_question": f"WITH {RETRIEVED} SELECT question, paper_id, distance, rank FROM matches",
    "question_contexts": f"WITH {RETRIEVED} SELECT question, context FROM question_texts",
    "question_contexts_by_year": f"""WITH {RETRIEVED}
        SELECT question, year, string_agg(title || ': ' || abstract, ' | ' ORDER BY rank) AS papers
        FROM matches JOIN papers USING (paper_id) GROUP BY question, year""",
    "question_prompts": f"""WITH {RETRIEVED}
        SELECT question, 'Answer the question from the context below.' || chr(10) || chr(10) || 'Context: '
               || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt
        FROM distinct_questions LEFT JOIN question_texts USING (question)""",
    "answered_questions": f"""WITH {RETRIEVED}
        SELECT question, right('Context: ' || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question
               || chr(10) || chr(10) || 'Answer:', 60) AS answer, CAST(NULL AS VARCHAR) AS error
        FROM distinct_questions LEFT JOIN question_texts USING (question)""",
    "stored_notes": f"WITH {PAPERS},{FLAT} SELECT * FROM flat",
    "array_notes": f"WITH {PAPERS},{FLAT} SELECT * FROM flat",
    "stored_papers": f"""WITH {PAPERS},{FLAT}
        SELECT conference, paper_id, number, title, abstract, venue, decision FROM flat WHERE title <> '' AND abstract <> ''""",
    "stored_collection": f"""WITH {PAPERS},{FLAT}
        SELECT paper_id, title, conference, coalesce(venue, 'unknown') AS venue, CAST(right(conference, 4) AS INTEGER) AS year,
               keywords, CAST(NULL AS VARCHAR) AS summary
        FROM flat WHERE title <> '' AND abstract <> ''""",
    "rejected_papers": f"""WITH {PAPERS}
        SELECT paper_id, source AS conference, CAST(NULL AS INTEGER) AS year FROM papers WHERE doc_id % 10 = 3""",
    "enrichment_failures": f"""WITH {PAPERS},{PENDING}
        SELECT paper_id, CASE WHEN length(abstract) % 2 = 0 THEN {_strip("left(abstract, 40)")} END AS summary,
               length(abstract) % 2 = 1 AS failed, CAST(CASE WHEN length(abstract) % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS attempts
        FROM pending""",
    "pending_summaries": f"WITH {PAPERS},{PENDING} SELECT paper_id, abstract, FALSE AS has_summary FROM pending",
    "applied_summaries": APPLIED,
    "folded_summaries": APPLIED,
    "summary_coverage": f"""WITH {PAPERS}
        SELECT count(*) AS total,
               count(*) FILTER (WHERE abstract <> '' AND coalesce(summary, '') <> '') AS with_summary,
               count(*) FILTER (WHERE abstract <> '' AND coalesce(summary, '') = '') AS without_summary,
               count(*) FILTER (WHERE abstract = '') AS without_abstract
        FROM papers""",
    "summary_samples": f"""WITH {PAPERS}
        SELECT paper_id, left(title, 100) AS title, abstract <> '' AS has_abstract,
               coalesce(summary, '') <> '' AS has_summary, left(summary, 200) AS summary
        FROM papers ORDER BY paper_id LIMIT 5""",
    "stripped_reasoning": f"WITH {RESPONSES} SELECT response_id, {ANSWER} AS answer FROM responses",
    "model_topic_lines": f"""WITH {RESPONSES}, answers AS (SELECT response_id, {ANSWER} AS answer FROM responses),
        lines AS (
          SELECT response_id, list_filter(list_transform(string_split(answer, chr(10)),
                   lambda s: {_strip(f"regexp_replace({_strip('s')}, '^[-*] ', '')")}), lambda s: s <> '') AS ls
          FROM answers)
        SELECT response_id, CAST(rank AS INTEGER) AS rank, topic FROM (
          SELECT response_id, unnest(ls) AS topic, unnest(range(1, len(ls) + 1)) AS rank FROM lines) WHERE rank <= 10""",
    "rendered_prompts": f"""WITH {PAPERS},{PENDING}
        SELECT paper_id, replace({_quote(SUMMARY_TEMPLATE)}, '{{abstract}}', abstract) AS prompt FROM pending""",
    "prompt_comparison": f"""WITH {PAPERS}, catalog(template, body) AS (VALUES {TEMPLATE_ROWS})
        SELECT template, count(*) AS prompts, CAST(sum(length(replace(body, '{{abstract}}', abstract))) AS BIGINT) AS prompt_chars,
               round(avg(length(replace(body, '{{abstract}}', abstract))), 6) AS mean_prompt_chars
        FROM catalog CROSS JOIN papers GROUP BY template""",
    "topics_prompt": f"""WITH {PAPERS},{TOPIC_PROMPTS} SELECT prompt_id, prompt FROM prompts""",
    "model_topics": f"""WITH {PAPERS},{TOPIC_PROMPTS},
        named AS (SELECT DISTINCT prompt_id, {_strip("unnest(string_split(replace(prompt, chr(10), ' '), ' ')[1:3])")} AS topic FROM prompts),
        counts AS (SELECT topic, CAST(count(*) AS DOUBLE) AS score FROM named WHERE topic <> '' GROUP BY topic)
        SELECT CAST(row_number() OVER (ORDER BY score DESC, topic) AS INTEGER) AS rank, topic, score FROM counts
        ORDER BY score DESC, topic LIMIT 15""",
    "extractive_summary": f"""WITH {PAPERS},
        wanted AS (SELECT * FROM papers WHERE abstract <> '' AND coalesce(summary, '') = ''),{_extract("wanted")}
        SELECT paper_id, summary FROM extracts""",
    "enrichment_counters": f"WITH {PAPERS},{PENDING} SELECT count(*) AS processed, CAST(0 AS BIGINT) AS errors FROM pending",
    "enrichment_incremental": f"""WITH {PAPERS},
        wanted AS (SELECT * FROM papers WHERE abstract <> ''),{_extract("wanted")}
        SELECT paper_id, summary FROM extracts""",
    "enrichment_chunks": f"""WITH {PAPERS}
        SELECT paper_id, {DIGEST} AS summary, 'done' AS status, 1 AS attempts, 0 AS attempt FROM papers WHERE abstract <> ''""",
    "enrichment_stopped": f"""WITH {PAPERS}
        SELECT 1 AS run, CAST(0 AS BIGINT) AS processed, CAST(5 AS BIGINT) AS errors, TRUE AS skipped_some, CAST(5 AS BIGINT) AS calls
        UNION ALL SELECT 2, 0, 1, TRUE, 1
        UNION ALL SELECT 3, count(*), 0, FALSE, count(*) FROM papers WHERE abstract <> ''""",
    "enrichment_run_counters": f"""WITH {PAPERS}, counted AS (
          SELECT count(*) FILTER (WHERE length(abstract) % 7 <> 3) AS processed, count(*) FILTER (WHERE length(abstract) % 7 = 3) AS errors,
                 count(*) AS calls
          FROM papers WHERE abstract <> '')
        SELECT processed, errors, CAST(0 AS BIGINT) AS skipped, calls, processed AS table_processed, errors AS table_errors,
               CAST(0 AS BIGINT) AS table_skipped
        FROM counted""",
    "enrichment_deadlines": f"""WITH {PAPERS},{PENDING}, judged AS (
          SELECT paper_id, abstract, CASE WHEN length(abstract) % 200 = 7 THEN 'timeout' WHEN length(abstract) % 10 = 3 THEN 'error'
                                          WHEN length(abstract) % 10 = 5 THEN 'connection' END AS kind
          FROM pending)
        SELECT paper_id, CASE WHEN kind IS NULL THEN {DIGEST} END AS summary, CASE WHEN kind IS NULL THEN 'done' ELSE 'failed' END AS status, kind,
               CAST(CASE WHEN kind = 'connection' THEN 3 ELSE 1 END AS INTEGER) AS attempts
        FROM judged""",
    "run_statistics": """
        SELECT count(*) AS runs, count(*) FILTER (WHERE role = 'system') AS failed,
               round(sum(s) / count(*), 6) AS mean_seconds, round(CAST(sum(c) AS DOUBLE) / count(*), 6) AS mean_chars,
               round(sum(s), 6) AS total_seconds, round(sum(s) / count(*) * 13223 / 3600, 6) AS corpus_hours
        FROM (SELECT role, CASE WHEN role <> 'system' THEN CAST(turn + 1 AS DOUBLE) END AS s,
                     CASE WHEN role <> 'system' THEN length(text) END AS c FROM conversations)""",
    "trend_report": f"WITH {REPORT}\n{FACTS}",
    "stored_report": f"WITH {REPORT} SELECT * FROM ({FACTS}) WHERE section <> 'trend_percentage'",
    "report_lines": f"WITH {REPORT}\n{LINES}",
}
