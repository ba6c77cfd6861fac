"""The SQL that says how packed proteins split, for the queries that begin with it."""

_QUOTED = """"(?:[^"\\\\]|\\\\.|"")*"|'(?:[^'\\\\]|\\\\.|'')*'"""
#: Group 1: a quoted value, group 2: a plain one, up to the next delimiter.
_VALUE = rf"(?s)[\s\v]*(?:({_QUOTED})[\s\v]*|((?:\\.|[^\\])*?)[\s\v]*)(?:[\t:;,]|(?:^|\s)\|(?:\s|$)|$)".replace("'", "''")
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(65279)"
_PLAIN = "regexp_replace({}, '\\\\(.)', '\\1', 'gs')"

#: CTEs up to p1(row_id, pos, protein).
SPLIT_SQL = f"""b AS (SELECT row_id, trim(proteins, {_BLANKS}) AS t FROM psms),
    w AS (SELECT row_id, CASE WHEN length(t) > 1 AND (t[1] || t[-1]) IN ('[]', '{{}}', '()', '<>') THEN t[2:-2] ELSE t END AS t FROM b WHERE t <> ''),
    e AS (SELECT row_id, regexp_extract_all(t, '{_VALUE}', 1) AS q, regexp_extract_all(t, '{_VALUE}', 2) AS u FROM w),
    v AS (SELECT row_id, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS q, unnest(u) AS u FROM e),
    s AS (SELECT row_id, i, trim(CASE WHEN q <> '' THEN {_PLAIN.format("replace(q[2:-2], q[1] || q[1], q[1])")} ELSE {_PLAIN.format("u")} END, {_BLANKS}) AS protein FROM v),
    p1 AS (SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY i))::INTEGER AS pos, protein FROM s WHERE protein <> '')"""
