"""The same results in DuckDB SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

from passagework.catalog import QUESTION, QUESTIONS, ROUTED_QUESTION
from passagework.functions.sentence_model import EDGE
from passagework.operators.prompt import DEFAULT_TEMPLATE


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# pages, sentences, groups and chunks; a page is a line of the text, or the whole text

LINE_PAGES = """
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
             CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS page_number
      FROM documents),
pages AS (SELECT doc_id, page_number, trim(raw) AS text FROM p)"""

WHOLE_PAGES = """
pages AS (SELECT doc_id, source AS document_name, lang, CAST(1 AS INTEGER) AS page_number,
                 trim(replace(text, chr(10), ' ')) AS text FROM documents)"""

SENTENCES = r"""
s AS (SELECT * EXCLUDE (text), list_filter(string_split(
             regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sentences
      FROM pages)"""


def _log_share(hits: str, tries: str, share: str) -> str:
    some = f"CASE WHEN {hits} > 0 THEN {hits} * ln({share}) ELSE 0 END"
    return f"({some} + CASE WHEN {tries} - {hits} > 0 THEN ({tries} - {hits}) * ln(1 - {share}) ELSE 0 END)"


def _type(word: str) -> str:
    return f"lower(trim({word}, {_quote(EDGE)}))"


# words of a page, their types with and without a full stop, and what follows sentence ends
SENTENCE_MODEL = rf"""
w AS (SELECT doc_id, page_number, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM pages),
t AS (SELECT {_type("word")} AS type, count(*) FILTER (suffix(word, '.')) AS stopped, count(*) AS total
      FROM (SELECT unnest(words) AS word FROM w) WHERE regexp_matches({_type("word")}, '\p{{L}}') GROUP BY 1),
n AS (SELECT sum(total)::DOUBLE AS words, sum(stopped) / sum(total) AS share FROM t),
a AS (SELECT type, stopped AS seen, total,
             2 * (stopped * ln(0.99 / share) + (total - stopped) * ln((1 - 0.99) / (1 - share)))
             * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1)
             * pow(length(replace(type, '.', '')), stopped - total) AS score
      FROM t, n WHERE stopped >= 3 AND share > 0 AND share < 1 AND score >= 0.3),
f AS (SELECT {_type("p.word")} AS type, count(*) AS seen
      FROM (SELECT unnest(list_zip(words[1:len(words) - 1], words[2:])) AS z, {{'before': z[1], 'word': z[2]}} AS p
            FROM w WHERE len(words) > 1)
      WHERE regexp_matches(p.before, '[.!?]$') AND regexp_matches({_type("p.word")}, '\p{{L}}')
        AND NOT (suffix(p.before, '.') AND {_type("p.before")} IN (SELECT type FROM a)) GROUP BY 1),
m AS (SELECT sum(seen)::DOUBLE AS ends FROM f),
b AS (SELECT type, seen, total,
             2 * ({_log_share("seen", "ends", "(seen / ends)")}
                  + {_log_share("(total - seen)", "(words - ends)", "((total - seen) / (words - ends))")}
                  - {_log_share("seen", "ends", "(total / words)")}
                  - {_log_share("(total - seen)", "(words - ends)", "(total / words)")}) AS score
      FROM f JOIN t USING (type), n, m WHERE seen >= 3 AND seen / ends > total / words AND score >= 30),
model AS (SELECT 'abbreviation' AS kind, * FROM a UNION ALL SELECT 'starter', * FROM b)"""

LAST_WORD = r"regexp_extract(part, '(\S+)\s*$', 1)"
FIRST_WORD = r"regexp_extract(following, '^\S+')"

# pieces up to every possible end, numbered anew at every end that is one
TRAINED_SENTENCES = rf"""
c AS (SELECT doc_id, page_number, list_filter(string_split(
             regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM pages),
e AS (SELECT doc_id, page_number, unnest(parts) AS part, generate_subscripts(parts, 1) AS i,
             unnest(parts[2:] || ['']) AS following FROM c),
g AS (SELECT *, suffix(rtrim(part), '.') AND {_type(LAST_WORD)} IN (SELECT type FROM a)
             AND NOT (regexp_matches(following, '^\p{{Lu}}')
                      AND {_type(FIRST_WORD)} IN (SELECT type FROM b)) AS goes_on FROM e),
k AS (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (
             PARTITION BY doc_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM g)"""


def _chunks(size: int = 10, pages: str = LINE_PAGES) -> str:
    return (
        pages
        + ","
        + SENTENCES
        + rf""",
g AS (SELECT * EXCLUDE (sentences), unnest(list_transform(range(0, len(sentences), {size}),
             lambda i: struct_pack(idx := i // {size}, parts := sentences[i + 1 : i + {size}]))) AS u FROM s),
c AS (SELECT * EXCLUDE (u), CAST(u.idx AS INTEGER) AS chunk_idx, u.parts AS parts, regexp_replace(
             trim(replace(array_to_string(u.parts, ''), '  ', ' ')), '\.([A-Z])', '. \1', 'g') AS sentence_chunk
      FROM g),
chunks AS (SELECT * EXCLUDE (parts), CAST(length(sentence_chunk) AS BIGINT) AS chunk_char_count,
                  CAST(len(string_split(sentence_chunk, ' ')) AS BIGINT) AS chunk_word_count,
                  length(sentence_chunk) / 4 AS chunk_token_count FROM c)"""
    )


WHOLE_CHUNKS = _chunks(pages=WHOLE_PAGES) + """,
kept AS (SELECT * FROM chunks WHERE chunk_token_count > 30)"""

KEYS = "doc_id, page_number, chunk_idx"
CHUNK_COLUMNS = f"{KEYS}, sentence_chunk, chunk_char_count, chunk_word_count, chunk_token_count"

# the hashing encoder: md5 bucket counts per text, unit length, float32


def _weights(name: str, source: str, keys: str, dim: int = 768) -> str:
    return f"""
{name}_n AS (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b, count(*) AS n
      FROM (SELECT {keys}, unnest(string_split(lower({source[1]}), ' ')) AS w FROM {source[0]})
      WHERE w <> '' GROUP BY ALL),
{name} AS (SELECT {keys}, b, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS FLOAT)::DOUBLE AS x
      FROM {name}_n)"""


CHUNK_WEIGHTS = _weights("cw", ("kept", "sentence_chunk"), KEYS)

_LITERAL_ROWS = ", ".join(
    f"({qid}, {_quote(text)}, {5 if n is None else n})" for qid, text, n in QUESTIONS
)
ASKED = {
    "one": f"asked AS (SELECT * FROM (VALUES (1, {_quote(QUESTION)}, 5)) AS v(qid, text, n_results))",
    "literal": f"asked AS (SELECT * FROM (VALUES {_LITERAL_ROWS}) AS v(qid, text, n_results))",
    "benchmark": "asked AS (SELECT item_id AS qid, text, 5 AS n_results FROM benchmark)",
    "turns": "asked AS (SELECT conv_id * 1000000 + turn AS qid, text, 5 AS n_results "
    "FROM conversations WHERE role = 'user')",
    "routed": "asked AS (SELECT DISTINCT regexp_extract(source, '(\\d+)', 1)::BIGINT AS qid, "
    f"{_quote(ROUTED_QUESTION)} AS text, 3 AS n_results, source AS document_name FROM documents)",
}


def _search(asked: str) -> str:
    """Every query against every kept chunk, words in common or not."""
    own = "AND k.document_name = a.document_name" if asked == "routed" else ""
    return f"""WITH {WHOLE_CHUNKS}, {CHUNK_WEIGHTS}, {ASKED[asked]},
{_weights("qw", ("asked", "text"), "qid")},
common AS (SELECT qid, {KEYS}, sum(cw.x * qw.x) AS raw FROM cw JOIN qw USING (b) GROUP BY ALL),
scored AS (SELECT a.qid, a.text AS query, a.n_results, k.*, round(coalesce(raw, 0), 5) AS score
      FROM kept k JOIN asked a ON true {own} LEFT JOIN common USING (qid, {KEYS})),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, {KEYS}) AS INTEGER) AS rank
      FROM scored QUALIFY rank <= n_results)"""


HIT_COLUMNS = f"CAST(qid AS BIGINT) AS qid, rank, {KEYS}, document_name"

_context, _query = DEFAULT_TEMPLATE.split("{context}")[0], DEFAULT_TEMPLATE.split("{context}")[1]
_middle, _end = _query.split("{query}")
PROMPT = f"{_quote(_context)} || context || {_quote(_middle)} || query || {_quote(_end)}"
CONTEXTS = """,
contexts AS (SELECT CAST(qid AS BIGINT) AS qid, any_value(query) AS query,
      '- ' || string_agg(sentence_chunk, chr(10) || '- ' ORDER BY rank) AS context FROM hits GROUP BY qid)"""


def oracle_sql() -> dict[str, str]:
    lines = "WITH " + LINE_PAGES
    with_sentences = lines + "," + SENTENCES
    chunks = "WITH " + _chunks()
    whole = "WITH " + WHOLE_CHUNKS
    by_lang = f"SELECT lang AS document_name, {KEYS}, sentence_chunk FROM kept"
    small = "WITH " + _chunks(5, WHOLE_PAGES) + ", kept AS (SELECT * FROM chunks WHERE chunk_token_count > 30)"
    small_by_lang = f"{small} SELECT lang AS document_name, {KEYS}, sentence_chunk FROM kept"
    question = _weights("qw", ("asked", "text"), "qid", 64)
    dot64 = """CAST(coalesce(sum(e.x::DOUBLE * qw.x), 0) AS DOUBLE)"""
    cells = "cells AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS b FROM embeddings)"
    value = "CAST(embedding[i + 1] AS DOUBLE)"
    return {
        "text_normalize": "SELECT doc_id, trim(replace(text, chr(10), ' ')) AS text FROM documents",
        "page_scan": f"{lines} SELECT doc_id, page_number, text FROM pages",
        "page_stats": f"""{lines} SELECT doc_id, page_number, text,
            CAST(length(text) AS BIGINT) AS page_char_count,
            CAST(len(string_split(text, ' ')) AS BIGINT) AS page_word_count,
            CAST(len(string_split(text, '. ')) AS BIGINT) AS page_sentence_count_raw,
            length(text) / 4 AS page_token_count FROM pages""",
        "page_quarantine": f"""{lines} SELECT doc_id, page_number,
            CASE WHEN regexp_matches(raw, '[^\\x00-\\x7F]') THEN NULL ELSE trim(raw) END AS text,
            CASE WHEN regexp_matches(raw, '[^\\x00-\\x7F]') THEN 'outside ASCII' END AS error FROM p""",
        "document_quarantine": f"""{lines},
            refused AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]'))
            SELECT doc_id, page_number, text, CAST(NULL AS VARCHAR) AS error FROM pages ANTI JOIN refused USING (doc_id)
            UNION ALL SELECT doc_id, CAST(0 AS INTEGER), NULL, 'UnicodeDecodeError' FROM refused""",
        "extract_crash": f"""{lines}, e AS (SELECT doc_id, page_number, text, CASE
                WHEN page_number = 1 AND doc_id % 250 = 7 THEN 'crashed'
                WHEN page_number = 2 AND doc_id % 500 = 11 THEN 'no answer in time'
                WHEN page_number = 1 AND doc_id % 500 = 13 THEN 'MemoryError' END AS error FROM pages)
            SELECT doc_id, page_number, CASE WHEN error IS NULL THEN text END AS text, error FROM e""",
        "sentences": f"""{with_sentences} SELECT doc_id, page_number, unnest(sentences) AS sentence,
            CAST(generate_subscripts(sentences, 1) - 1 AS INTEGER) AS pos FROM s""",
        "sentence_model": f"{lines}, {SENTENCE_MODEL} SELECT kind, type, seen, total, round(score, 5) AS score FROM model",
        "sentences_trained": f"""{lines}, {SENTENCE_MODEL}, {TRAINED_SENTENCES}
            SELECT doc_id, page_number, CAST(pos AS INTEGER) AS pos, rtrim(string_agg(part, '' ORDER BY i)) AS sentence
            FROM k GROUP BY doc_id, page_number, pos""",
        "sentence_count": f"""{with_sentences}
            SELECT doc_id, page_number, CAST(len(sentences) AS BIGINT) AS page_sentence_count FROM s""",
        "chunk_groups": f"""{chunks} SELECT {KEYS}, unnest(parts) AS sentence,
            CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos FROM c""",
        "num_chunks": f"""{with_sentences} SELECT doc_id, page_number,
            CAST(ceil(len(sentences) / 10) AS BIGINT) AS num_chunks FROM s""",
        "chunks": f"{chunks} SELECT {KEYS}, sentence_chunk FROM chunks",
        "chunks_size5": f"WITH {_chunks(5)} SELECT {KEYS}, sentence_chunk FROM chunks",
        "chunks_whole_document": f"""WITH {_chunks(10, WHOLE_PAGES)}
            SELECT document_name, {KEYS}, sentence_chunk FROM chunks""",
        "chunk_stats": f"{chunks} SELECT * EXCLUDE (sentence_chunk) FROM chunks",
        "chunk_filter": f"{chunks} SELECT * FROM chunks WHERE chunk_token_count > 30",
        "ingest_metrics": f"""{chunks},
            per_page AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS pages,
                CAST(sum(len(sentences)) AS BIGINT) AS sentences FROM s GROUP BY doc_id),
            per_chunk AS (SELECT doc_id, count(*) AS chunks,
                count(*) FILTER (chunk_token_count > 30) AS kept_chunks FROM chunks GROUP BY doc_id)
            SELECT doc_id, pages, sentences, coalesce(chunks, 0) AS chunks, coalesce(kept_chunks, 0) AS kept_chunks
            FROM per_page LEFT JOIN per_chunk USING (doc_id)""",
        "ingest_multi": f"{chunks} SELECT * FROM chunks",
        "embed_chunks": f"""{whole}, {CHUNK_WEIGHTS}
            SELECT {KEYS}, CAST(b AS INTEGER) AS bucket, round(x, 5) AS weight FROM cw""",
        "embed_by_length": f"""{whole}, {CHUNK_WEIGHTS}
            SELECT {KEYS}, CAST(b AS INTEGER) AS bucket, round(x, 5) AS weight FROM cw""",
        "embed_failures": f"""{whole}
            SELECT {KEYS} FROM kept WHERE regexp_matches(sentence_chunk, '[^\\x00-\\x7F]')""",
        "vector_parse": f"""SELECT vec_id, CAST(i AS INTEGER) AS pos, {value} AS value
            FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
        "vector_pad": f"""SELECT vec_id, CAST(i AS INTEGER) AS pos, coalesce({value}, 0) AS value
            FROM (SELECT vec_id, embedding, unnest(range(96)) AS i FROM embeddings)""",
        "vector_truncate": f"""SELECT vec_id, CAST(i AS INTEGER) AS pos, {value} AS value
            FROM (SELECT vec_id, embedding, unnest(range(32)) AS i FROM embeddings)""",
        "vector_cast": f"""SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(CAST({value} / 3 AS FLOAT) AS DOUBLE) AS value
            FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
        "dot_scores": f"""WITH {ASKED["one"]}, {question}, {cells}
            SELECT vec_id, round({dot64}, 5) AS score FROM cells e LEFT JOIN qw USING (b) GROUP BY vec_id""",
        "top_k": f"""WITH {ASKED["one"]}, {question}, {cells}
            SELECT vec_id, round({dot64}, 5) AS score FROM cells e LEFT JOIN qw USING (b) GROUP BY vec_id
            ORDER BY score DESC, vec_id LIMIT 5""",
        "vector_search": f"""WITH {ASKED["benchmark"]}, {question}, {cells},
            scored AS (SELECT qid, vec_id, round({dot64}, 5) AS score
                FROM cells e JOIN qw USING (b) GROUP BY qid, vec_id)
            SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                vec_id, score FROM scored QUALIFY rank <= 5""",
        "quantised_search": f"""WITH {ASKED["benchmark"]}, {question}, {cells},
            scored AS (SELECT qid, vec_id, round({dot64}, 5) AS score
                FROM cells e JOIN qw USING (b) GROUP BY qid, vec_id)
            SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                vec_id, score FROM scored QUALIFY rank <= 5""",
        "semantic_search": f"{_search('one')} SELECT {HIT_COLUMNS}, sentence_chunk, chunk_char_count, "
        "chunk_word_count, chunk_token_count, score FROM hits",
        "semantic_search_multi": f"{_search('benchmark')} SELECT {HIT_COLUMNS}, score FROM hits",
        "clustered_search": f"{_search('benchmark')} SELECT {HIT_COLUMNS}, score FROM hits",
        "semantic_search_n": f"{_search('literal')} SELECT {HIT_COLUMNS}, score FROM hits",
        "semantic_search_batch": f"{_search('turns')} SELECT {HIT_COLUMNS}, score FROM hits",
        "postings_search": f"{_search('literal')} SELECT {HIT_COLUMNS}, score FROM hits",
        "search_payload": f"{_search('benchmark')} SELECT {HIT_COLUMNS}, sentence_chunk, chunk_char_count, "
        "chunk_word_count, chunk_token_count, score FROM hits",
        "context_block": f"{_search('literal')}{CONTEXTS} SELECT qid, context FROM contexts",
        "prompt_assemble": f"{_search('literal')}{CONTEXTS} SELECT qid, query, {PROMPT} AS prompt FROM contexts",
        "chat_messages": f"{_search('literal')}{CONTEXTS} SELECT qid, 'user' AS role, {PROMPT} AS content FROM contexts",
        "answer_rows": f"{_search('routed')}{CONTEXTS} SELECT qid, query, {PROMPT} AS results FROM contexts",
        "corpus_route": f"{whole} SELECT document_name, {KEYS}, sentence_chunk FROM kept WHERE document_name = 'src3'",
        "preview": f"{whole} SELECT {KEYS}, sentence_chunk FROM kept ORDER BY {KEYS} LIMIT 5",
        "sink_create_if_absent": f"{whole} {by_lang} WHERE lang = 'en' "
        f"UNION ALL SELECT * FROM ({small_by_lang} WHERE lang <> 'en')",
        "sink_append": f"{whole} {by_lang} UNION ALL {by_lang} WHERE lang = 'en'",
        "csv_roundtrip": f"""{whole}, {CHUNK_WEIGHTS}
            SELECT document_name, {CHUNK_COLUMNS}, CAST(768 AS INTEGER) AS dim, CAST(b AS INTEGER) AS bucket,
                round(x, 5) AS weight FROM kept JOIN cw USING ({KEYS})""",
        "csv_multiline": f"""{whole}
            SELECT document_name, doc_id, page_number, chunk_idx,
                regexp_replace(sentence_chunk, '([a-z])\\. ', '\\1."' || chr(10), 'g') AS sentence_chunk,
                chunk_char_count, chunk_word_count, chunk_token_count,
                CASE WHEN doc_id % 7 <> 0 THEN '0 -2 0' END AS embedding,
                document_name || chr(10) || '",' || doc_id AS filename FROM kept""",
        "ingest_files": f"""{whole} SELECT 'uploads' AS document_name, doc_id || '.txt' AS filename, page_number,
            chunk_idx, sentence_chunk FROM kept""",
        "ingest_quarantine": f"""{whole}, n AS (SELECT doc_id, n_chars FROM documents)
            SELECT doc_id, document_name, CAST(NULL AS VARCHAR) AS reason FROM kept JOIN n USING (doc_id)
            WHERE lang <> 'fr' AND n_chars >= 200
            UNION ALL SELECT doc_id, CASE WHEN lang <> 'fr' THEN source END,
                CASE WHEN lang = 'fr' THEN 'document name is missing' ELSE 'text is missing' END
            FROM documents WHERE lang = 'fr' OR n_chars < 200""",
        "embed_failure_counts": f"""{whole}, f AS (
            SELECT count(*) AS kept, count(*) FILTER (regexp_matches(sentence_chunk, '[^\\x00-\\x7F]')) AS failed FROM kept)
            SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM chunks) AS chunks, kept,
                failed AS failed_embeddings, kept - failed AS saved, failed > 0 AS has_reason FROM f""",
        "scored_rows": f"{whole} SELECT count(*) AS rows_scored FROM kept",
        "stream_uploads": """SELECT doc_id, source AS document_name, 'new' AS change, CAST(length(text) AS INTEGER) AS n_chars FROM documents
            UNION ALL SELECT doc_id, source, 'changed', CAST(length(text) + 1 AS INTEGER) FROM documents WHERE doc_id % 6 = 0""",
        "stream_ingest": f"{chunks} SELECT * FROM chunks WHERE chunk_token_count > 30",
    }
