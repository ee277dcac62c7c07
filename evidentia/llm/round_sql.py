"""SQL for DuckDB of the repair, decontamination and manifest queries."""

#: CRC-32 of a short ASCII text, by bits: a list of a start value and bytes is reduced.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))))"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
    WITH b AS MATERIALIZED (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
    bw AS (SELECT item, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
    win AS MATERIALIZED (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bw)),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    dw AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win))),
    h AS MATERIALIZED (SELECT DISTINCT r, i, dw.l, item FROM dw JOIN win ON win.l = dw.l AND win.t = dw.t),
    p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + l)) AS j FROM (SELECT DISTINCT r, i, l FROM h)) GROUP BY r),
    q AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(q.n, 0) AS n_items, coalesce(q.s, sha256('')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN q ON q.r = d.r"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE = f"""
    WITH RECURSIVE t AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf,
               CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents),
    s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS size FROM t GROUP BY source),
    l AS MATERIALIZED (SELECT t.*, s.tree, s.size, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM t JOIN s ON s.source IS NOT DISTINCT FROM t.source),
    n AS (SELECT tree, 0 AS height, CAST(size AS BIGINT) AS size, idx, leaf AS digest FROM l
          UNION ALL SELECT tree, height + 1, (size + 2) // 3, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM n WHERE size > 1 GROUP BY tree, height, size, idx // 3),
    m AS MATERIALIZED (SELECT * FROM n),
    sub AS MATERIALIZED (SELECT tree, digest AS subroot, max(height) AS top FROM m WHERE size = 1 GROUP BY tree, digest),
    c AS (SELECT 0 AS height, (SELECT count(*) FROM sub) AS size, tree AS idx, subroot AS digest FROM sub
          UNION ALL SELECT height + 1, (size + 2) // 3, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM c WHERE size > 1 GROUP BY height, size, idx // 3),
    k AS MATERIALIZED (SELECT * FROM c),
    steps AS (SELECT l.r, m.height, string_agg(CASE WHEN m.idx < e THEN digest ELSE '' END, '' ORDER BY m.idx) AS before, string_agg(CASE WHEN m.idx > e THEN digest ELSE '' END, '' ORDER BY m.idx) AS after
              FROM (SELECT l.*, h, idx // CAST(pow(3, h) AS BIGINT) AS e FROM l JOIN sub USING (tree), unnest(range(top)) AS u(h)) l
              JOIN m ON m.tree = l.tree AND m.height = l.h AND m.idx // 3 = l.e // 3 GROUP BY l.r, m.height),
    tops AS (SELECT tree, k.height, string_agg(CASE WHEN k.idx < e THEN digest ELSE '' END, '' ORDER BY k.idx) AS before, string_agg(CASE WHEN k.idx > e THEN digest ELSE '' END, '' ORDER BY k.idx) AS after
             FROM (SELECT tree, h, tree // CAST(pow(3, h) AS BIGINT) AS e FROM sub, unnest(range((SELECT max(height) FROM k))) AS u(h)) x
             JOIN k ON k.height = x.h AND k.idx // 3 = x.e // 3 GROUP BY tree, k.height),
    path AS MATERIALIZED (SELECT r, row_number() OVER (PARTITION BY r ORDER BY upper, height) AS i, before, after
             FROM (SELECT r, 0 AS upper, height, before, after FROM steps UNION ALL SELECT l.r, 1, height, before, after FROM l JOIN tops USING (tree))),
    f AS (SELECT r, 0 AS i, tampered AS digest FROM l UNION ALL SELECT f.r, path.i, sha256(before || digest || after) FROM f JOIN path ON path.r = f.r AND path.i = f.i + 1),
    proof AS (SELECT r, max(i) AS n, string_agg(before || after, '' ORDER BY i) AS all_of FROM path GROUP BY r)
    SELECT doc_id, leaf, subroot, k.digest AS root, sha256(coalesce(all_of, '')) AS proof_sha256, f.digest AS folded_root, f.digest = k.digest AS verified
    FROM l JOIN sub USING (tree) JOIN k ON k.size = 1 LEFT JOIN proof ON proof.r = l.r JOIN f ON f.r = l.r AND f.i = coalesce(proof.n, 0)"""

_SEEN = "row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n)"
_KINDS = (("s", ("s",)), ("u", ("e", "s", "a")), ("a", ("u",)))


def _best(*options: str) -> str:
    """The least of the (cost, audit, text) of which some may be null."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _state(come: dict[str, str]) -> str:
    return ", ".join(f"{come[k]} AS {k}" for k in "esua")


def _more(frm: str, cost: str, audit: str, text: str) -> str:
    return f"CASE WHEN {frm} IS NULL THEN NULL ELSE {{'c': {frm}.c + {cost}, 'a': {frm}.a || {audit}, 't': {frm}.t || {text}}} END"


def _row(state: str) -> str:
    """What a row makes of the states: it is deleted, kept or gets another role, in that state's place."""
    own = "chr(10) || {0} || ':' || text"
    options = [_more(f"j.{state}", "2", "'D'", "''"), f"CASE WHEN fault IN ('', 'truncated') AND initial = '' THEN {_more(f'j.{state}', 'late', chr(39) + 'K' + chr(39), own.format('role'))} END"]
    before = {"e": (), "s": ("e",), "u": ("e", "s", "a"), "a": ("u",)}[state]
    for frm in before:
        options.append(f"CASE WHEN fault IN ('', 'truncated') AND initial = '{state}' THEN {_more(f'j.{frm}', 'late', chr(39) + 'K' + chr(39), own.format('role'))} END")
        if state in "ua":
            name = {"u": "'user'", "a": "'assistant'"}[state]
            options.append(f"CASE WHEN fault IN ('', 'truncated') THEN {_more(f'j.{frm}', '1 + late', chr(39) + 'R' + chr(39), own.format(name))} END")
    return _best(*options)


def _inserted(p: str) -> str:
    """The states after at most two insertions."""
    ins = lambda frm, name: _more(frm, "5", "'I'", f"chr(10) || '{name}:'")
    u = _best(f"{p}.u", ins(f"{p}.e", "user"), ins(f"{p}.s", "user"), ins(f"{p}.a", "user"))
    a = _best(f"{p}.a", ins(f"{p}.u", "assistant"), ins(f"({_best(ins(f'{p}.e', 'user'), ins(f'{p}.s', 'user'))})", "assistant"))
    return _state({"e": f"{p}.e", "s": f"{p}.s", "u": u, "a": a})


REPAIR = f"""
    WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS what FROM conversations),
    y AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS n FROM x WHERE what <> 0),
    z AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i,
                 CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN {_SEEN} > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM y),
    r AS MATERIALIZED (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM z),
    b0 AS (SELECT DISTINCT conv_id, {{'c': 0, 'a': '', 't': ''}} AS e, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s,
                  CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS a FROM r),
    w AS (SELECT 0 AS i, conv_id, {_inserted("p")} FROM b0 p
          UNION ALL SELECT i, conv_id, {_inserted("p")} FROM (
              SELECT r.i, r.conv_id, {_state({k: _row(k) for k in "esua"})} FROM w j JOIN r ON r.conv_id IS NOT DISTINCT FROM j.conv_id AND r.i = j.i + 1) p),
    m AS (SELECT conv_id, count(*) AS n, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
          FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id),
    o AS (SELECT w.conv_id, {_best("w.e", "w.a")} AS best FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.i)
    SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
           CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
           sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM q.conv_id"""
