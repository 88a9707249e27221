"""DuckDB SQL for every registered query (the correctness oracle).

Fragments are shared through common table expressions; patterns are the same strings
the Spark side uses (``spanlake.functions.text``).
"""

from __future__ import annotations

from spanlake.functions.text import (
    ASCII_PUNCTUATION,
    GAP_TOKEN_PATTERN,
    ROUGE_SPLIT,
    TOK13A_ENTITIES,
    TOK13A_RULES,
    TOKEN_PATTERN,
    WS_CLASS,
)

PUNCT_SQL = ASCII_PUNCTUATION.replace("'", "''")


def ws_split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS_CLASS}]+'), lambda t: t <> '')"


def squad_tokens(x: str) -> str:
    return (
        f"list_filter({ws_split(f'translate(lower({x}), {chr(39)}{PUNCT_SQL}{chr(39)}, {chr(39)}{chr(39)})')}, "
        "lambda t: t NOT IN ('a', 'an', 'the'))"
    )


QA_EXAMPLES = """
qa_examples AS (
  SELECT CAST(d.doc_id AS VARCHAR) || '-' || CAST(b.item_id AS VARCHAR) AS id,
         d.doc_id, b.item_id, b.text AS question, b.text AS answer,
         instr(d.text, b.text) - 1 AS answer_start,
         instr(d.text, b.text) - 1 + length(b.text) AS answer_end,
         d.text AS context
  FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0
)"""

RUNS = QA_EXAMPLES + """,
runs AS (
  SELECT 'exact' AS run, id, answer AS prediction_text, answer FROM qa_examples
  UNION ALL
  SELECT 'wide', id,
         substring(context, greatest(answer_start - 20, 0) + 1,
                   answer_end + 20 - greatest(answer_start - 20, 0)), answer
  FROM qa_examples
  UNION ALL
  SELECT 'empty', id, '', answer FROM qa_examples
)"""


def bag_overlap(a: str, b: str) -> str:
    return (
        f"coalesce((SELECT sum(least(ca, cb)) FROM "
        f"(SELECT x, count(*) AS ca FROM unnest({a}) u(x) GROUP BY x) qa JOIN "
        f"(SELECT x, count(*) AS cb FROM unnest({b}) u(x) GROUP BY x) qb USING (x)), 0)"
    )


SQUAD_ROWS = RUNS + f""",
toks AS (
  SELECT run, id, prediction_text, answer,
         {squad_tokens('prediction_text')} AS pt, {squad_tokens('answer')} AS gt
  FROM runs
),
ov AS (SELECT *, {bag_overlap('pt', 'gt')} AS same FROM toks)
"""

ORACLE: dict[str, str] = {}

ORACLE["flatten_qa"] = f"""
WITH {QA_EXAMPLES}
SELECT question, answer, CAST(answer_start AS BIGINT) AS answer_start,
       CAST(answer_end AS BIGINT) AS answer_end, context, id
FROM qa_examples
"""

ORACLE["squad_em_f1"] = f"""
WITH {SQUAD_ROWS}
SELECT run, id,
       CAST(array_to_string(pt, ' ') = array_to_string(gt, ' ') AS DOUBLE) AS em,
       round(CASE WHEN same = 0 THEN 0.0
             ELSE 2 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END, 6) AS f1
FROM ov
"""

PAIRS = """
pairs AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS pair_id,
         u.conv_id, u.turn, u.text AS "Query", a.text AS "Segment"
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

ORACLE["drop_all_duplicates"] = """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)
"""

ORACLE["drop_all_duplicate_pairs"] = f"""
WITH {PAIRS}
SELECT "Query", "Segment" FROM pairs GROUP BY "Query", "Segment" HAVING count(*) = 1
"""

ORACLE["shuffle_rank"] = """
SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT) AS rank
FROM documents
"""

ORACLE["sample_exact"] = """
SELECT doc_id, lang, rank FROM (
  SELECT doc_id, lang,
         CAST(row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT) AS rank
  FROM documents) WHERE rank <= 100
"""

ORACLE["train_val_split"] = f"""
WITH {PAIRS},
r AS (
  SELECT pair_id, CAST(row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) AS BIGINT) AS rank,
         count(*) OVER () AS n
  FROM pairs)
SELECT pair_id, CASE WHEN rank <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split, rank FROM r
"""

TOKENS_DOCS = f"""
pieces AS (
  SELECT doc_id,
         unnest(regexp_extract_all(text, '{GAP_TOKEN_PATTERN}', 1)) AS gap,
         unnest(regexp_extract_all(text, '{GAP_TOKEN_PATTERN}', 2)) AS tok,
         unnest(range(len(regexp_extract_all(text, '{GAP_TOKEN_PATTERN}', 2)))) AS pos
  FROM documents
),
doc_tokens AS (
  SELECT doc_id, pos, tok,
         CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(tok) AS BIGINT) AS start,
         CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end"
  FROM pieces
)"""

ORACLE["tokenize_offsets"] = f"""
WITH {TOKENS_DOCS}
SELECT doc_id, CAST(pos AS BIGINT) AS pos, tok, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end"
FROM doc_tokens
"""


def qa_windows(max_length: int, stride: int, n_special: int = 3, examples: str = QA_EXAMPLES) -> str:
    """Window rows of qa_examples with their context tokens (range join on pos)."""
    return f"""
{examples},
{TOKENS_DOCS},
doc_n AS (SELECT doc_id, count(*) AS n FROM doc_tokens GROUP BY doc_id),
ex AS (
  SELECT e.id, e.doc_id, e.answer_start AS sc, e.answer_end AS ec,
         len(regexp_extract_all(e.question, '{TOKEN_PATTERN}', 0)) AS qn,
         coalesce(dn.n, 0) AS n
  FROM qa_examples e LEFT JOIN doc_n dn USING (doc_id)
),
p AS (SELECT *, {max_length - n_special} - qn AS cap, {max_length - n_special - stride} - qn AS step FROM ex),
w AS (
  SELECT *, unnest(range(CASE WHEN n <= cap THEN 1
                              ELSE CAST(ceil((n - cap) / step) AS BIGINT) + 1 END)) AS window_no
  FROM p WHERE step > 0
),
wt AS (
  SELECT w.*, t.pos, t.start, t."end"
  FROM w LEFT JOIN doc_tokens t
    ON t.doc_id = w.doc_id AND t.pos >= w.window_no * w.step AND t.pos < w.window_no * w.step + w.cap
),
wins AS (
  SELECT id, window_no, qn, step, sc, ec,
         count(pos) AS n_ctx, min(start) AS ctx_start, max("end") AS ctx_end,
         count(*) FILTER (WHERE start <= sc) AS n_le,
         count(*) FILTER (WHERE "end" >= ec) AS n_ge
  FROM wt GROUP BY id, window_no, qn, step, sc, ec
)"""


ORACLE["sliding_windows"] = f"""
WITH {qa_windows(128, 32)}
SELECT id, CAST(window_no AS BIGINT) AS window_no, CAST(qn AS BIGINT) AS q_len,
       CAST(window_no * step AS BIGINT) AS ctx_first, CAST(n_ctx AS BIGINT) AS n_ctx,
       CAST(qn + 3 + n_ctx AS BIGINT) AS seq_len,
       CAST(ctx_start AS BIGINT) AS ctx_start, CAST(ctx_end AS BIGINT) AS ctx_end
FROM wins
"""

ORACLE["align_span"] = f"""
WITH {qa_windows(128, 32)}
SELECT id, CAST(window_no AS BIGINT) AS window_no,
       CAST(CASE WHEN sc IS NULL OR ec IS NULL OR n_ctx = 0 OR ctx_start > sc OR ctx_end < ec THEN 0
            ELSE qn + 2 + n_le - 1 END AS BIGINT) AS start_position,
       CAST(CASE WHEN sc IS NULL OR ec IS NULL OR n_ctx = 0 OR ctx_start > sc OR ctx_end < ec THEN 0
            ELSE qn + 2 + n_ctx - n_ge END AS BIGINT) AS end_position
FROM wins
"""


def span_positions(max_length: int = 64, stride: int = 16, n_special: int = 3, whole: bool = False) -> str:
    """Every position of every document window with its offsets and logits: one logit per vector
    component, with ``whole`` one per position of the sequence (the vector repeated)."""
    cap = max_length - n_special
    step = cap - stride
    size = f"CAST(least({cap}, n - window_no * {step}) + {n_special} AS BIGINT)" if whole else "m"
    return f"""
{TOKENS_DOCS},
doc_n AS (
  SELECT d.doc_id, count(t.pos) AS n FROM documents d LEFT JOIN doc_tokens t USING (doc_id)
  GROUP BY d.doc_id
),
w AS (
  SELECT doc_id, n, unnest(range(CASE WHEN n <= {cap} THEN 1
                                      ELSE CAST(ceil((n - {cap}) / {step}) AS BIGINT) + 1 END)) AS window_no
  FROM doc_n
),
we AS (
  SELECT w.doc_id, w.window_no, w.n, e.embedding AS emb, len(e.embedding) AS m
  FROM w JOIN embeddings e ON e.vec_id = w.doc_id
),
pos AS (
  SELECT doc_id, window_no, n, emb, m, unnest(range({size})) AS p FROM we
),
lp AS (
  SELECT doc_id, window_no, p,
         emb[((p + window_no) % m) + 1] AS sv,
         emb[((m - 1 - p % m + window_no) % m) + 1] AS ev,
         CASE WHEN p >= {n_special - 1} AND p - {n_special - 1} < least({cap}, n - window_no * {step})
              THEN window_no * {step} + p - {n_special - 1} END AS tpos
  FROM pos
)"""


def top_spans(n_best: int) -> str:
    return f""",
top_s AS (
  SELECT doc_id, window_no, p, tpos, sv,
         row_number() OVER (PARTITION BY doc_id, window_no ORDER BY sv DESC, p DESC) - 1 AS r
  FROM lp QUALIFY r < {n_best}
),
top_e AS (
  SELECT doc_id, window_no, p, tpos, ev,
         row_number() OVER (PARTITION BY doc_id, window_no ORDER BY ev DESC, p DESC) - 1 AS r
  FROM lp QUALIFY r < {n_best}
)"""


SPAN = span_positions() + top_spans(5)

ORACLE["top_n_indices"] = f"""
WITH {SPAN}
SELECT s.doc_id AS id, CAST(s.window_no AS BIGINT) AS window_no, s.top_start, e.top_end
FROM (SELECT doc_id, window_no, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY r) AS top_start
      FROM top_s GROUP BY ALL) s
JOIN (SELECT doc_id, window_no, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY r) AS top_end
      FROM top_e GROUP BY ALL) e USING (doc_id, window_no)
"""

def best_span(span: str, max_answer: int) -> str:
    return f"""
WITH {span},
cand AS (
  SELECT s.doc_id, s.window_no, s.r AS sr, e.r AS er, s.tpos AS ts, e.tpos AS te,
         CAST(s.sv + e.ev AS FLOAT) AS score
  FROM top_s s JOIN top_e e USING (doc_id, window_no)
  WHERE s.tpos IS NOT NULL AND e.tpos IS NOT NULL AND e.p >= s.p AND e.p - s.p + 1 <= {max_answer}
),
best AS (
  SELECT * FROM cand
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, window_no, sr, er) = 1
),
chars AS (
  SELECT b.doc_id, b.score, ts_.start AS start_char, te_."end" AS end_char
  FROM best b
  JOIN doc_tokens ts_ ON ts_.doc_id = b.doc_id AND ts_.pos = b.ts
  JOIN doc_tokens te_ ON te_.doc_id = b.doc_id AND te_.pos = b.te
)
SELECT d.doc_id AS id,
       coalesce(substring(d.text, c.start_char + 1, c.end_char - c.start_char), '') AS prediction_text,
       CAST(c.start_char AS BIGINT) AS start_char, CAST(c.end_char AS BIGINT) AS end_char,
       round(CAST(c.score AS DOUBLE), 5) AS score
FROM documents d LEFT JOIN chars c USING (doc_id)
"""


ORACLE["best_span"] = best_span(SPAN, 10)
ORACLE["span_from_logits"] = best_span(span_positions(512, 128, whole=True) + top_spans(20), 100)


def tokens_13a(x: str) -> str:
    s = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for ent, rep in TOK13A_ENTITIES:
        s = f"replace({s}, '{ent}', '{rep}')"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in TOK13A_RULES:
        s = f"regexp_replace({s}, '{pat}', '{rep.replace('$', chr(92))}', 'g')"
    return ws_split(s)


def rouge_tokens(x: str) -> str:
    return ws_split(f"regexp_replace(lower({x}), '{ROUGE_SPLIT}', ' ', 'g')")


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return (f"list_transform(range(1, len({t}) - {n - 2}), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], chr(31)))")


def bleu_rows(tok) -> str:
    ng = ",\n".join(
        f"SELECT run, id, {n} AS n, len(p) AS pl, len(r) AS rl, "
        f"{bag_overlap(ngrams('p', n), ngrams('r', n))} AS num, greatest(len(p) - {n - 1}, 0) AS den FROM toks"
        for n in range(1, 5)
    ).replace(",\nSELECT", " UNION ALL SELECT")
    return RUNS + f""",
toks AS (SELECT run, id, {tok('prediction_text')} AS p, {tok('answer')} AS r FROM runs),
st AS ({ng}),
agg AS (
  SELECT run, id, any_value(pl) AS pl, any_value(rl) AS rl, min(num) AS mn,
         sum(ln(CASE WHEN num > 0 THEN CAST(num AS DOUBLE) / den END)) AS sl
  FROM st GROUP BY run, id
)"""


BLEU_VALUE = """CASE WHEN mn = 0 OR pl = 0 THEN 0.0
  ELSE (CASE WHEN pl > rl THEN 1.0 ELSE exp(1.0 - CAST(rl AS DOUBLE) / pl) END) * exp(sl / 4.0) END"""

ORACLE["sentence_bleu"] = f"""
WITH {bleu_rows(ws_split)}
SELECT run, id, round({BLEU_VALUE}, 6) AS bleu FROM agg
"""

ORACLE["sacre_bleu"] = f"""
WITH {bleu_rows(tokens_13a)}
SELECT run, id, round({BLEU_VALUE}, 6) AS sacre_bleu FROM agg
"""

ORACLE["corpus_bleu"] = f"""
WITH {bleu_rows(ws_split)},
c AS (
  SELECT run, n, sum(num) AS num, sum(den) AS den FROM st GROUP BY run, n
),
lens AS (SELECT run, sum(pl) AS pl, sum(rl) AS rl FROM agg GROUP BY run),
cc AS (
  SELECT run, min(num) AS mn, sum(ln(CASE WHEN num > 0 THEN CAST(num AS DOUBLE) / den END)) AS sl
  FROM c GROUP BY run
)
SELECT run, round({BLEU_VALUE}, 6) AS corpus_bleu FROM cc JOIN lens USING (run)
"""


def rouge_rows(n: int) -> str:
    return RUNS + f""",
toks AS (SELECT run, id, {rouge_tokens('prediction_text')} AS p, {rouge_tokens('answer')} AS r FROM runs),
g AS (SELECT run, id, {ngrams('p', n)} AS gp, {ngrams('r', n)} AS gr FROM toks),
h AS (SELECT run, id, len(gp) AS np, len(gr) AS nr, {bag_overlap('gp', 'gr')} AS hits FROM g),
prf AS (
  SELECT run, id, np, nr, hits,
         CASE WHEN np = 0 OR nr = 0 OR hits = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / np END AS pr,
         CASE WHEN np = 0 OR nr = 0 OR hits = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / nr END AS rc
  FROM h
)"""


for _n in (1, 2):
    ORACLE[f"rouge_{_n}"] = f"""
WITH {rouge_rows(_n)}
SELECT run, id, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS fmeasure
FROM prf
"""


def _leaderboard() -> str:
    sq = f"""
sq AS (
  SELECT run, id,
         CAST(array_to_string(pt, ' ') = array_to_string(gt, ' ') AS DOUBLE) AS em,
         CASE WHEN same = 0 THEN 0.0
              ELSE 2 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END AS f1
  FROM ov
)"""
    return f"""
WITH {SQUAD_ROWS.replace(RUNS, RUNS)},
{sq},
bl AS (SELECT * FROM ({ORACLE['sentence_bleu'].replace('WITH ', 'WITH ', 1)})),
sb AS (SELECT * FROM ({ORACLE['sacre_bleu']})),
r1 AS (SELECT run, id, precision AS r1p, recall AS r1r, fmeasure AS r1f FROM ({ORACLE['rouge_1']})),
r2 AS (SELECT run, id, precision AS r2p, recall AS r2r, fmeasure AS r2f FROM ({ORACLE['rouge_2']})),
nref AS (SELECT count(*) AS n FROM qa_examples)
SELECT run, CAST(any_value(nref.n) AS BIGINT) AS n,
       round(sum(em) * 100 / any_value(nref.n), 6) AS exact_match,
       round(sum(f1) * 100 / any_value(nref.n), 6) AS f1,
       round(sum(bleu) / any_value(nref.n), 6) AS bleu,
       round(sum(sacre_bleu) / any_value(nref.n), 6) AS sacre_bleu_score,
       round(sum(r1f) / any_value(nref.n), 6) AS rouge1_fmeasure,
       round(sum(r1p) / any_value(nref.n), 6) AS rouge1_precision,
       round(sum(r1r) / any_value(nref.n), 6) AS rouge1_recall,
       round(sum(r2f) / any_value(nref.n), 6) AS rouge2_fmeasure,
       round(sum(r2p) / any_value(nref.n), 6) AS rouge2_precision,
       round(sum(r2r) / any_value(nref.n), 6) AS rouge2_recall
FROM sq JOIN bl USING (run, id) JOIN sb USING (run, id) JOIN r1 USING (run, id) JOIN r2 USING (run, id), nref
GROUP BY run
"""


ORACLE["leaderboard"] = _leaderboard()


ORACLE["build_vocab"] = f"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '{TOKEN_PATTERN}', 0)) AS tok FROM documents)
SELECT tok, CAST(count(*) AS BIGINT) AS cnt,
       CAST(row_number() OVER (ORDER BY count(*) DESC, tok) - 1 + 4 AS BIGINT) AS id
FROM t GROUP BY tok
"""

PAIR_TOKENS = PAIRS + f""",
ptok AS (
  SELECT pair_id, 'q' AS side, unnest(regexp_extract_all("Query", '{TOKEN_PATTERN}', 0)) AS tok,
         unnest(range(len(regexp_extract_all("Query", '{TOKEN_PATTERN}', 0)))) AS pos FROM pairs
  UNION ALL
  SELECT pair_id, 's', unnest(regexp_extract_all("Segment", '{TOKEN_PATTERN}', 0)),
         unnest(range(len(regexp_extract_all("Segment", '{TOKEN_PATTERN}', 0)))) FROM pairs
),
vocab AS (
  SELECT tok, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 + 4 AS id
  FROM ptok GROUP BY tok
),
pid AS (
  SELECT p.pair_id, s.side, list(v.id ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL) AS ids
  FROM pairs p CROSS JOIN (VALUES ('q'), ('s')) s(side)
  LEFT JOIN ptok t ON t.pair_id = p.pair_id AND t.side = s.side
  LEFT JOIN vocab v ON v.tok = t.tok
  GROUP BY p.pair_id, s.side
),
enc AS (
  SELECT pair_id,
         [2] || coalesce(max(ids) FILTER (WHERE side = 'q'), []) || [3] AS q_full,
         [2] || coalesce(max(ids) FILTER (WHERE side = 's'), []) || [3] AS s_full,
         [2] || coalesce(max(ids) FILTER (WHERE side = 'q'), [])[1:62] || [3] AS q64,
         [2] || coalesce(max(ids) FILTER (WHERE side = 's'), [])[1:62] || [3] AS s64
  FROM pid GROUP BY pair_id
)"""


def ids_str(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ' ')"


ORACLE["encode_pairs"] = f"""
WITH {PAIR_TOKENS}
SELECT pair_id,
       {ids_str('list_resize(q64, 64, 0)')} AS input_ids,
       {ids_str('list_resize(list_transform(q64, lambda v: 1), 64, 0)')} AS attention_mask,
       {ids_str('list_resize(s64, 64, 0)')} AS labels
FROM enc
"""

ORACLE["batch_pad"] = f"""
WITH {PAIR_TOKENS},
r AS (
  SELECT *, CAST((row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) - 1) // 16 AS BIGINT) AS batch
  FROM enc
),
m AS (SELECT *, max(greatest(len(q_full), len(s_full))) OVER (PARTITION BY batch) AS L FROM r)
SELECT pair_id, batch,
       {ids_str('list_resize(q_full, L, 0)')} AS input_ids,
       {ids_str('list_resize(list_transform(q_full, lambda v: 1), L, 0)')} AS attention_mask,
       {ids_str('list_resize(s_full, L, -100)')} AS labels
FROM m
"""

ORACLE["decode_text"] = f"""
WITH {PAIR_TOKENS},
dec AS (
  SELECT pair_id, tok, pos FROM ptok WHERE side = 's' AND pos < 62
)
SELECT p.pair_id, coalesce(string_agg(d.tok, ' ' ORDER BY d.pos), '') AS text
FROM pairs p LEFT JOIN dec d USING (pair_id)
GROUP BY p.pair_id
"""


def lexical(max_length: int, stride: int) -> str:
    """Windows of qa_examples plus the question-term hits with their idf weight."""
    return qa_windows(max_length, stride) + f""",
qterms AS (
  SELECT id, list_distinct(list_transform(regexp_extract_all(question, '{TOKEN_PATTERN}', 0),
                                          lambda t: lower(t))) AS qset
  FROM qa_examples
),
ctx AS (
  SELECT w.id, w.window_no, w.qn, w.step, t.pos, lower(t.tok) AS term
  FROM w JOIN doc_tokens t
    ON t.doc_id = w.doc_id AND t.pos >= w.window_no * w.step AND t.pos < w.window_no * w.step + w.cap
),
ndoc AS (SELECT count(*) AS "N" FROM qa_examples),
dfreq AS (
  SELECT lower(t.tok) AS term, count(DISTINCT e.id) AS df
  FROM qa_examples e JOIN doc_tokens t ON t.doc_id = e.doc_id GROUP BY 1
),
hits AS (
  SELECT c.id, c.window_no, c.qn + 2 + c.pos - c.window_no * c.step AS seqpos,
         ln(("N" + 1) / (df + 1)) + 1 AS weight
  FROM ctx c JOIN qterms q USING (id) JOIN dfreq USING (term), ndoc
  WHERE list_contains(q.qset, c.term)
)"""


ORACLE["lexical_score"] = f"""
WITH {lexical(128, 32)}
SELECT id, CAST(window_no AS BIGINT) AS window_no, CAST(seqpos AS BIGINT) AS pos,
       round(weight, 6) AS weight
FROM hits
"""


def _span_end_to_end() -> str:
    return f"""
WITH {lexical(512, 128)},
posn AS (
  SELECT id, window_no, qn, step, n_ctx, unnest(range(512)) AS p FROM wins
),
lg AS (
  SELECT n.id, n.window_no, n.qn, n.step, n.p,
         CASE WHEN n.p >= n.qn + 2 AND n.p < n.qn + 2 + n.n_ctx THEN n.window_no * n.step + n.p - n.qn - 2 END AS tpos,
         CAST(CASE WHEN n.p >= n.qn + 2 AND n.p < n.qn + 2 + n.n_ctx THEN coalesce(h.weight, 0.0)
                   ELSE -10000.0 END AS FLOAT) AS v
  FROM posn n LEFT JOIN hits h ON h.id = n.id AND h.window_no = n.window_no AND h.seqpos = n.p
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY id, window_no ORDER BY v DESC, p DESC) - 1 AS r
  FROM lg QUALIFY r < 20
),
cand AS (
  SELECT s.id, s.window_no, s.r AS sr, e.r AS er, s.tpos AS ts, e.tpos AS te, CAST(s.v + e.v AS FLOAT) AS score
  FROM top s JOIN top e USING (id, window_no)
  WHERE s.tpos IS NOT NULL AND e.tpos IS NOT NULL AND e.p >= s.p AND e.p - s.p + 1 <= 100
),
best AS (
  SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, window_no, sr, er) = 1
),
pred AS (
  SELECT e.id, e.answer,
         coalesce(substring(e.context, a.start + 1, b2."end" - a.start), '') AS prediction_text
  FROM qa_examples e
  LEFT JOIN best b ON b.id = e.id
  LEFT JOIN doc_tokens a ON a.doc_id = e.doc_id AND a.pos = b.ts
  LEFT JOIN doc_tokens b2 ON b2.doc_id = e.doc_id AND b2.pos = b.te
),
tk AS (SELECT id, prediction_text, {squad_tokens('prediction_text')} AS pt, {squad_tokens('answer')} AS gt FROM pred),
ov AS (SELECT *, {bag_overlap('pt', 'gt')} AS same FROM tk)
SELECT id, prediction_text,
       CAST(array_to_string(pt, ' ') = array_to_string(gt, ' ') AS DOUBLE) AS em,
       round(CASE WHEN same = 0 THEN 0.0
             ELSE 2 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END, 6) AS f1
FROM ov
"""


ORACLE["span_end_to_end"] = _span_end_to_end()


TERMS = f"list_distinct(list_transform(regexp_extract_all(\"Query\", '{TOKEN_PATTERN}', 0), lambda x: lower(x)))"

# the query itself, or the segment of the training query of the largest shared idf weight (all compared)
ECHO = f"""
gen AS (SELECT pair_id, "Segment" AS answer, "Query" AS generated FROM val)"""
NEAREST = f"""
train AS (SELECT * FROM r WHERE rank > ceil(n * 0.1)),
tt AS (SELECT pair_id AS d, unnest({TERMS}) AS term FROM train),
tw AS (SELECT term, round((ln(((SELECT count(*) FROM train WHERE len({TERMS}) > 0) + 1) / (count(*) + 1)) + 1) * 1000)::BIGINT AS w FROM tt GROUP BY term),
vt AS (SELECT pair_id, unnest({TERMS}) AS term FROM val),
sc AS (SELECT pair_id, d, sum(w) AS score FROM vt JOIN tw USING (term) JOIN tt USING (term) GROUP BY pair_id, d),
top AS (SELECT pair_id, d FROM sc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, d) = 1),
gen AS (
  SELECT val.pair_id, val."Segment" AS answer, coalesce(train."Segment", '') AS generated
  FROM val LEFT JOIN top USING (pair_id) LEFT JOIN train ON train.pair_id = top.d
)"""


def _pair_end_to_end(generated: str) -> str:
    return f"""
WITH {PAIRS},
uniq AS (
  SELECT any_value(pair_id) AS pair_id, "Query", "Segment" FROM pairs
  GROUP BY "Query", "Segment" HAVING count(*) = 1
),
r AS (
  SELECT *, row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) AS rank, count(*) OVER () AS n
  FROM uniq
),
val AS (SELECT * FROM r WHERE rank <= ceil(n * 0.1)),
{generated},
pred AS (
  SELECT pair_id, answer, array_to_string(regexp_extract_all(generated, '{TOKEN_PATTERN}', 0)[1:62], ' ') AS prediction_text
  FROM gen
),
tk AS (
  SELECT pair_id, prediction_text, answer, {squad_tokens('prediction_text')} AS pt, {squad_tokens('answer')} AS gt,
         {ws_split('prediction_text')} AS p, {ws_split('answer')} AS r
  FROM pred
),
ov AS (SELECT *, {bag_overlap('pt', 'gt')} AS same FROM tk),
st AS (
  {" UNION ALL ".join(
      f"SELECT pair_id, {n} AS n, len(p) AS pl, len(r) AS rl, {bag_overlap(ngrams('p', n), ngrams('r', n))} AS num, "
      f"greatest(len(p) - {n - 1}, 0) AS den FROM tk" for n in range(1, 5))}
),
agg AS (
  SELECT pair_id, any_value(pl) AS pl, any_value(rl) AS rl, min(num) AS mn,
         sum(ln(CASE WHEN num > 0 THEN CAST(num AS DOUBLE) / den END)) AS sl
  FROM st GROUP BY pair_id
)
SELECT pair_id, prediction_text,
       CAST(array_to_string(pt, ' ') = array_to_string(gt, ' ') AS DOUBLE) AS em,
       round(CASE WHEN same = 0 THEN 0.0
             ELSE 2 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END, 6) AS f1,
       round({BLEU_VALUE}, 6) AS bleu
FROM ov JOIN agg USING (pair_id)
"""


ORACLE["pair_end_to_end"] = _pair_end_to_end(NEAREST)
ORACLE["pair_echo"] = _pair_end_to_end(ECHO)

ORACLE["stream_tokenize"] = ORACLE["tokenize_offsets"]


def _lcs(longer: str, shorter: str) -> str:
    """Bit-parallel LCS length in SQL: one 128-bit word per row (shorter side <= 126)."""
    one = "CAST(1 AS HUGEINT)"
    mask = (f"list_sum(list_transform(range(len({shorter})), lambda j: "
            f"CASE WHEN {shorter}[j + 1] = x THEN ({one} << j) ELSE CAST(0 AS HUGEINT) END))")
    full = f"(({one} << len({shorter})) - 1)"
    step = f"lambda v, x: ((v + (v & {mask})) | (v & ~{mask})) & {full}"
    return f"(len({shorter}) - bit_count(list_reduce({longer}, {step}, {full})))"


ORACLE["rouge_l"] = RUNS + f""",
t0 AS (SELECT run, id, {rouge_tokens('prediction_text')} AS p, {rouge_tokens('answer')} AS r FROM runs),
t1 AS (
  SELECT run, id, p, r,
         CASE WHEN len(p) <= len(r) THEN p ELSE r END AS sb,
         CASE WHEN len(p) <= len(r) THEN r ELSE p END AS la
  FROM t0
),
h AS (SELECT run, id, len(p) AS np, len(r) AS nr, {_lcs('la', 'sb')} AS hits FROM t1),
prf AS (
  SELECT run, id,
         CASE WHEN np = 0 OR nr = 0 OR hits = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / np END AS pr,
         CASE WHEN np = 0 OR nr = 0 OR hits = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / nr END AS rc
  FROM h
)
SELECT run, id, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS fmeasure
FROM prf
"""
ORACLE["rouge_l"] = "WITH " + ORACLE["rouge_l"]


ORACLE["csv_round_trip"] = ORACLE["flatten_qa"]
ORACLE["json_round_trip"] = ORACLE["flatten_qa"]

ORACLE["tsv_round_trip"] = f"""
WITH {PAIRS}
SELECT "Query", "Segment" FROM pairs
"""

ORACLE["split_counts"] = f"""
WITH {PAIRS},
uniq AS (
  SELECT any_value(pair_id) AS pair_id FROM pairs GROUP BY "Query", "Segment" HAVING count(*) = 1
),
r AS (
  SELECT pair_id, row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) AS rank, count(*) OVER () AS n
  FROM uniq
),
s AS (SELECT pair_id, CASE WHEN rank <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r)
SELECT (SELECT count(*) FROM pairs) AS n_pairs,
       count(*) AS n_unique,
       count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'val') AS n_val,
       least(count(*) FILTER (WHERE split = 'train'), 100) AS n_train_sampled
FROM s
"""

ORACLE["features_per_example"] = f"""
WITH {qa_windows(128, 32)}
SELECT id, CAST(count(*) AS BIGINT) AS n_windows,
       string_agg(CAST(window_no AS VARCHAR), ' ' ORDER BY window_no) AS window_nos
FROM wins GROUP BY id
"""

ORACLE["token_span_text"] = f"""
WITH {qa_windows(128, 32)},
lab AS (
  SELECT id, window_no, step, qn,
         CASE WHEN sc IS NULL OR ec IS NULL OR n_ctx = 0 OR ctx_start > sc OR ctx_end < ec THEN 0
              ELSE qn + 2 + n_le - 1 END AS sp,
         CASE WHEN sc IS NULL OR ec IS NULL OR n_ctx = 0 OR ctx_start > sc OR ctx_end < ec THEN 0
              ELSE qn + 2 + n_ctx - n_ge END AS ep
  FROM wins
)
SELECT l.id, CAST(l.window_no AS BIGINT) AS window_no,
       string_agg(t.tok, ' ' ORDER BY t.pos) AS span_tokens
FROM lab l
JOIN qa_examples e ON e.id = l.id
JOIN doc_tokens t ON t.doc_id = e.doc_id
 AND t.pos BETWEEN l.window_no * l.step + l.sp - l.qn - 2 AND l.window_no * l.step + l.ep - l.qn - 2
WHERE l.sp > 0
GROUP BY l.id, l.window_no
"""


def _window_rows(examples: str, max_length: int, stride: int) -> str:
    """Windows of examples given with their token counts (id, qn, n)."""
    return f"""
ex AS ({examples}),
p AS (SELECT *, {max_length - 3} - qn AS cap, {max_length - 3 - stride} - qn AS step FROM ex),
w AS (
  SELECT *, unnest(range(CASE WHEN step <= 0 OR n <= cap THEN 1 ELSE CAST(ceil((n - cap) / step) AS BIGINT) + 1 END)) AS window_no FROM p
),
f AS (
  SELECT *, CASE WHEN step <= 0 THEN 0 ELSE window_no * step END AS ctx_first,
         CASE WHEN step <= 0 THEN 0 ELSE greatest(0, least(cap, n - window_no * step)) END AS n_ctx
  FROM w
)"""


_COUNT = f"len(regexp_extract_all(text, '{TOKEN_PATTERN}', 0))"
ORACLE["window_edge_cases"] = f"""
WITH {_window_rows(f"""
  SELECT item_id::VARCHAR || '-no-question' AS id, 0 AS qn, {_COUNT} AS n FROM benchmark
  UNION ALL SELECT item_id::VARCHAR || '-no-context', {_COUNT}, 0 FROM benchmark
  UNION ALL SELECT item_id::VARCHAR || '-long-question', 10 * {_COUNT}, {_COUNT} FROM benchmark""", 512, 128)}
SELECT id, (step <= 0)::BIGINT AS too_long, window_no::BIGINT AS window_no, qn::BIGINT AS q_len, ctx_first::BIGINT AS ctx_first,
       n_ctx::BIGINT AS n_ctx, (qn + 3 + n_ctx)::BIGINT AS seq_len
FROM f
"""

ORACLE["unanswerable_labels"] = f"""
WITH {PAIRS},
{_window_rows(f"""
  SELECT pair_id AS id, len(regexp_extract_all("Query", '{TOKEN_PATTERN}', 0)) AS qn,
         len(regexp_extract_all("Segment", '{TOKEN_PATTERN}', 0)) AS n FROM pairs""", 256, 32)}
SELECT id, 'NA' AS answer, window_no::BIGINT AS window_no, n_ctx::BIGINT AS n_ctx, 0::BIGINT AS start_position, 0::BIGINT AS end_position
FROM f
"""

ORACLE["evaluate_missing"] = f"""
WITH {QA_EXAMPLES},
n AS (SELECT 2 * count(*) AS n FROM benchmark),
h AS (SELECT count(DISTINCT item_id) AS h FROM qa_examples)
SELECT run, n::BIGINT AS n, round(100.0 * s / n, 6)::DOUBLE AS exact_match, round(100.0 * s / n, 6)::DOUBLE AS f1
FROM n, (SELECT 'found' AS run, h AS s FROM h WHERE h > 0 UNION ALL SELECT 'stray', 0)
"""

ORACLE["rouge_report"] = f"""
WITH {QA_EXAMPLES},
r1 AS (SELECT run, id, precision AS p1, recall AS c1, fmeasure AS f1 FROM ({ORACLE['rouge_1']})),
r2 AS (SELECT run, id, precision AS p2, recall AS c2, fmeasure AS f2 FROM ({ORACLE['rouge_2']})),
rl AS (SELECT run, id, precision AS pl, recall AS cl, fmeasure AS fl FROM ({ORACLE['rouge_l']})),
n AS (SELECT count(*) AS n FROM qa_examples)
SELECT run, any_value(n)::BIGINT AS n,
       {", ".join(f"round(sum({c}{k}) / any_value(n), 6) AS {name}_{m}"
                  for k, name in (("1", "rouge1"), ("2", "rouge2"), ("l", "rougeL"))
                  for c, m in (("f", "fmeasure"), ("p", "precision"), ("c", "recall")))}
FROM r1 JOIN r2 USING (run, id) JOIN rl USING (run, id), n GROUP BY run
"""

ORACLE["row_ids"] = """
SELECT 'doc_id, text, lang, source, n_chars' AS features, count(*)::BIGINT AS num_rows, count(*)::BIGINT AS n_row_ids,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id, text FROM documents))::BIGINT AS n_row_keys,
       min(doc_id) AS first_id, arg_min(lang, doc_id) AS first_lang
FROM documents
"""

ORACLE["pair_references"] = f"""
WITH {PAIRS}
SELECT pair_id, "Query", "Segment" FROM pairs
"""

ORACLE["load_splits"] = f"""
WITH {PAIRS},
r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) AS rank, count(*) OVER () AS n FROM pairs),
s AS (SELECT CASE WHEN rank <= ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS split, * FROM r)
SELECT split, pair_id AS id, "Query" AS question, "Segment" AS answer, length("Segment")::BIGINT AS answer_end FROM s
UNION ALL SELECT 'all', pair_id, "Query", "Segment", length("Segment")::BIGINT FROM r
"""

ORACLE["map_batches"] = f"""
WITH {PAIRS}
SELECT pair_id, unnest(range(len(string_split("Segment", '. '))))::BIGINT AS no, unnest(string_split("Segment", '. ')) AS sentence FROM pairs
"""


ASKED = """
qa_examples AS (
  SELECT d.doc_id::VARCHAR || '-' || b.item_id::VARCHAR AS id, d.doc_id, b.text AS question,
         CASE WHEN instr(d.text, b.text) > 0 THEN instr(d.text, b.text) - 1 END AS answer_start,
         CASE WHEN instr(d.text, b.text) > 0 THEN instr(d.text, b.text) - 1 + length(b.text) END AS answer_end
  FROM documents d JOIN benchmark b ON b.item_id < 40 AND (b.item_id - d.doc_id) % 10 = 0
)"""

ORACLE["shared_contexts"] = f"""
WITH {qa_windows(256, 64, examples=ASKED)}
SELECT id, window_no::BIGINT AS window_no, qn::BIGINT AS q_len, (window_no * step)::BIGINT AS ctx_first, n_ctx::BIGINT AS n_ctx,
       (qn + 3 + n_ctx)::BIGINT AS seq_len, ctx_start::BIGINT AS ctx_start, ctx_end::BIGINT AS ctx_end,
       (CASE WHEN sc IS NULL OR n_ctx = 0 OR ctx_start > sc OR ctx_end < ec THEN 0 ELSE qn + 2 + n_le - 1 END)::BIGINT AS start_position,
       (CASE WHEN sc IS NULL OR n_ctx = 0 OR ctx_start > sc OR ctx_end < ec THEN 0 ELSE qn + 2 + n_ctx - n_ge END)::BIGINT AS end_position
FROM wins
"""

# decode(encode(x)) = x, and windows cover the texts without gaps
ORACLE["subword_round_trip"] = """
SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars, 0::BIGINT AS n_gaps FROM documents
"""
ORACLE["subword_windows"] = """
SELECT doc_id AS id, CASE WHEN text <> '' THEN 0 END::BIGINT AS first_char, CASE WHEN text <> '' THEN length(text) END::BIGINT AS last_char,
       0::BIGINT AS n_other, 0::BIGINT AS n_missing
FROM documents
"""

ORACLE["json_variant"] = f"""
WITH {QA_EXAMPLES},
s AS (SELECT *, doc_id % 4 AS shape FROM qa_examples)
SELECT CASE WHEN shape < 3 THEN question END AS question, CASE WHEN shape = 1 THEN 'NA' WHEN shape < 3 THEN answer END AS answer,
       CASE WHEN shape IN (0, 2) THEN answer_start END::BIGINT AS answer_start, CASE WHEN shape IN (0, 2) THEN answer_end END::BIGINT AS answer_end,
       CASE WHEN shape < 3 THEN context END AS context, CASE WHEN shape < 3 THEN id END AS id, CASE WHEN shape = 3 THEN 'not json' END AS problem
FROM s
"""
