"""DuckDB SQL for the results that SQL can express, written from the definitions of the results, not from the operators."""

from __future__ import annotations

from tracklane.llm.quality_rules import RULES, STOP_WORDS

#: Words and lines of every text; rows are told apart by a number of their own.
WORD = r"[^\x20\x09-\x0D]"
DOCS = "d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text,'') AS text FROM documents)"
WORDS = f"{DOCS}, w AS (SELECT rid, doc_id, text, REGEXP_EXTRACT_ALL(text,'{WORD}+') AS ws FROM d)"

LINE_DEDUP = f"""WITH {DOCS}, s AS (SELECT rid, doc_id, text, STRING_SPLIT(text,CHR(10)) AS ls FROM d),
p AS (SELECT rid, doc_id, i, ls[i]||CHR(10)||ls[i+1] AS pair FROM s, UNNEST(RANGE(1,LEN(ls))) AS q(i)),
gone AS (SELECT rid, i FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY pair ORDER BY doc_id NULLS LAST, i)>1),
li AS (SELECT rid, i, i-ROW_NUMBER() OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i FROM gone UNION SELECT rid, i+1 FROM gone)),
sz AS (SELECT li.rid, li.run, SUM(LENGTH(ls[i])) AS chars FROM li JOIN s ON li.rid=s.rid GROUP BY 1,2),
cut AS (SELECT li.rid, LIST(i) AS pos FROM li JOIN sz ON li.rid=sz.rid AND li.run=sz.run WHERE chars>=20 GROUP BY li.rid),
k AS (SELECT s.doc_id, s.text, CASE WHEN pos IS NULL THEN s.text ELSE ARRAY_TO_STRING(LIST_TRANSFORM(LIST_FILTER(RANGE(1,LEN(ls)+1), lambda i: NOT LIST_CONTAINS(pos,i)), lambda i: ls[i]),CHR(10)) END AS kept FROM s LEFT JOIN cut ON s.rid=cut.rid)
SELECT doc_id, LENGTH(kept) AS n_chars, LENGTH(text)-LENGTH(kept) AS n_removed, SHA256(kept) AS kept_sha256 FROM k"""

SUBSTRING_DEDUP = f"""WITH {WORDS}, p AS (SELECT rid, doc_id, i, ARRAY_TO_STRING(ws[i:i+19],' ') AS win FROM w, UNNEST(RANGE(1,LEN(ws)-18)) AS q(i)),
gone AS (SELECT rid, i FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, i)>1),
cut AS (SELECT rid, LIST(DISTINCT i+j) AS pos FROM gone, UNNEST(RANGE(0,20)) AS q(j) GROUP BY rid),
k AS (SELECT doc_id, LEN(ws) AS n_words, COALESCE(LEN(pos),0) AS n_removed, CASE WHEN pos IS NULL THEN ws ELSE LIST_TRANSFORM(LIST_FILTER(RANGE(1,LEN(ws)+1), lambda i: NOT LIST_CONTAINS(pos,i)), lambda i: ws[i]) END AS kept FROM w LEFT JOIN cut ON w.rid=cut.rid)
SELECT doc_id, n_words, n_removed, SHA256(COALESCE(ARRAY_TO_STRING(kept,' '),'')) AS kept_sha256 FROM k"""

ESCAPED = r"REPLACE(REPLACE(REPLACE({c},'\','\\'),'</turn>','<\/turn>'),'##','#\#')"
CHAT_FORMAT = rf"""WITH c AS (SELECT conv_id, turn, COALESCE(role,'') AS role, COALESCE(text,'') AS text FROM conversations UNION ALL SELECT -7, x, r, '\### Assistant: </turn> ok' FROM (VALUES (0,'user'),(1,'assistant')) q(x,r)),
g AS (SELECT conv_id, COUNT(*) AS n_turns, STRING_AGG(role||CHR(10)||text||CHR(10),'' ORDER BY turn, role, text) AS told, COALESCE(STRING_AGG(CASE WHEN role='assistant' THEN text END,'' ORDER BY turn, role, text),'') AS loss, CAST(SUM(LENGTH('### '||REPLACE({ESCAPED.format(c="role")},':','\:')||': '||{ESCAPED.format(c="text")}||'</turn>'||CHR(10))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, SHA256(told) AS turns_sha256, LENGTH(loss) AS loss_chars, SHA256(loss) AS loss_sha256, formatted_chars FROM g"""

_STOP = ",".join(f"'{x}'" for x in sorted({x for v in STOP_WORDS.values() for x in v.split()}))
_KEPT = " AND ".join(f"COALESCE({r.measure}{op}{v},false)" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
QUALITY = f"""WITH {WORDS}, v AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, win) AS times FROM (SELECT rid, i, ARRAY_TO_STRING(ws[i:i+7],' ') AS win FROM w, UNNEST(RANGE(1,LEN(ws)-6)) AS q(i))),
r AS (SELECT rid, COUNT(DISTINCT i+j) AS n FROM v, UNNEST(RANGE(0,8)) AS q(j) WHERE times>1 GROUP BY rid),
m AS (SELECT w.doc_id, LEN(ws) AS n_words, LENGTH(ARRAY_TO_STRING(ws,'')) AS word_chars, LEN(REGEXP_EXTRACT_ALL(text,'[#*$%&|<>]')) AS n_symbols, LIST_FILTER(STRING_SPLIT(text,CHR(10)), lambda l: REGEXP_MATCHES(l,'{WORD}')) AS ls, COALESCE(r.n,0) AS n_repeat_words, LENGTH(text)-LENGTH(REPLACE(text,'!','')) AS shouts, LEN(LIST_FILTER(ws, lambda x: LOWER(x) IN ({_STOP}))) AS stops FROM w LEFT JOIN r ON w.rid=r.rid),
f AS (SELECT *, LEN(ls)-LEN(LIST_DISTINCT(ls)) AS n_dup_lines, n_words<20 OR 100*n_repeat_words>30*n_words AS base_failed, NULLIF(n_words,0)::DOUBLE AS n FROM m),
t AS (SELECT *, n_repeat_words/n AS repeat_ratio, word_chars/n AS mean_word_chars, n_symbols/n AS symbol_ratio, shouts/n AS shout_ratio, stops/n AS stop_ratio, n_dup_lines/NULLIF(LEN(ls),0)::DOUBLE AS dup_line_ratio FROM f)
SELECT doc_id, n_words, COALESCE(word_chars,0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_KEPT} AS kept FROM t"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL_SEARCH = f"""WITH {DOCS}, t AS (SELECT rid, doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(text,'{UPPER}','{LOWER}'),'{TERM}') AS ts FROM d),
c AS (SELECT COUNT(*) AS n_docs, CAST(SUM(LEN(ts)) AS BIGINT) AS n_terms FROM t WHERE LEN(ts)>0),
q AS (SELECT item_id, term, COUNT(*) AS qtf FROM (SELECT item_id, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text,''),'{UPPER}','{LOWER}'),'{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT rid, doc_id, n, term, COUNT(*) AS tf FROM (SELECT rid, doc_id, LEN(ts) AS n, UNNEST(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY rid, doc_id, n, term),
w AS (SELECT term, CAST(FLOOR(1000*LN((2*n_docs+2)/(2*COUNT(*)+1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, rid, doc_id, CAST(SUM(qtf*w*((1000000000*tf)//(1000*tf+8*(100-75+((75*n*n_docs)//n_terms))))) AS BIGINT) AS score FROM p JOIN q USING (term) JOIN w USING (term), c GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score>0)
SELECT * FROM r WHERE rank<=10"""

#: crc32 byte by byte: 0xEDB88320 is the reflected polynomial; runs have code points below 256, so at most two bytes of UTF-8.
SPELLING = f"""WITH RECURSIVE tab AS (SELECT LIST(v ORDER BY i) AS tab FROM (SELECT i, LIST_REDUCE([i,0,0,0,0,0,0,0,0], lambda a, b: CASE WHEN a&1=1 THEN XOR(a>>1,3988292384) ELSE a>>1 END) AS v FROM RANGE(256) q(i))),
o AS (SELECT doc_id, run, COUNT(*) AS k FROM (SELECT doc_id, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text,''),'{UPPER}','{LOWER}'),'[a-zÀ-ÿ]+')) AS run FROM documents) WHERE LENGTH(run)>=6 GROUP BY doc_id, run),
b AS (SELECT run, k, FLATTEN(LIST_TRANSFORM(STRING_SPLIT(COALESCE(doc_id::VARCHAR,'')||':'||run,''), lambda x: CASE WHEN UNICODE(x)<128 THEN [UNICODE(x)::BIGINT] ELSE [195::BIGINT, UNICODE(x)-64] END)) AS bytes FROM o),
h AS (SELECT run, k, XOR(LIST_REDUCE(LIST_PREPEND(4294967295,bytes), lambda a, x: XOR(a>>8,tab[CAST(XOR(a&255,x) AS INTEGER)+1])),4294967295) AS h FROM b, tab),
v AS (SELECT word, CAST(SUM(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h%199=0 THEN run[1:h%LENGTH(run)]||run[h%LENGTH(run)+2:] ELSE run END AS word FROM h) WHERE LENGTH(word)>=6 GROUP BY word HAVING SUM(k)>=5),
x AS (SELECT word, n, i, word[1:i-1]||'*'||word[i+1:] AS swap, word[1:i-1]||word[i+1:] AS less FROM v, UNNEST(RANGE(1,LENGTH(word)+1)) AS q(i)),
e AS (SELECT DISTINCT a.word AS a, b.word AS b FROM x a JOIN x b ON a.swap=b.swap AND a.i=b.i WHERE a.word<>b.word UNION SELECT a.word, b.word FROM x a JOIN v b ON a.less=b.word UNION SELECT b.word, a.word FROM x a JOIN v b ON a.less=b.word),
m AS (SELECT a AS word, COUNT(*) AS n_near, MAX(v.n) AS top FROM e JOIN v ON e.b=v.word GROUP BY a),
g AS (SELECT m.word, n_near, top, MIN(b) AS best FROM m JOIN e ON m.word=e.a JOIN v ON v.word=e.b AND v.n=m.top GROUP BY m.word, n_near, top),
f AS (SELECT v.word, CASE WHEN top>=5*v.n THEN best END AS form, v.n, COALESCE(n_near,0) AS n_near, CASE WHEN top>=5*v.n THEN top END AS form_n FROM v LEFT JOIN g ON v.word=g.word),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root=f.word WHERE f.form IS NOT NULL),
z AS (SELECT t.word, t.root FROM t JOIN f ON t.root=f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word=z.word"""

ORACLE = {
    "op3_line_dedup": LINE_DEDUP,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op7_chat_format": CHAT_FORMAT,
    "op10_quality_rules": QUALITY,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_spelling_variants": SPELLING,
}
