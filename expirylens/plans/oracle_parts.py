"""DuckDB common table expressions that rebuild the derived tables from the structured dates.

They never parse text: the expected date of a token is the date it was printed from.
"""

from __future__ import annotations

PARTS: dict[str, str] = {
    "li": """SELECT l_orderkey, printf('img_%08d', l_orderkey) AS image_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
        CAST(l_shipdate AS DATE) + 9131 AS d, l_discount, l_tax FROM lineitem""",
    "dt": """SELECT image_id, l_orderkey, rn, d, rn % 5 AS form, CASE rn % 5
            WHEN 1 THEN strftime(d, '%Y.%m.%d') WHEN 2 THEN strftime(d, '%d/%m/%Y')
            WHEN 3 THEN strftime(d, '%Y%m%d') WHEN 4 THEN upper(strftime(d, '%d%b%Y'))
            ELSE strftime(d, '%Y년 %m월 %d일') END AS text,
        round(0.5 + l_discount * 4, 6) AS conf, round(0.4 + l_tax * 5, 6) AS det,
        CAST(70 + 100 * ((rn - 1) % 2) AS DOUBLE) AS x1, CAST(20 * rn AS DOUBLE) AS y1,
        CAST(150 + 100 * ((rn - 1) % 2) AS DOUBLE) AS x2, CAST(20 * rn + 18 AS DOUBLE) AS y2,
        CASE WHEN rn % 2 = 1 THEN 'baseline' ELSE 'yolo' END AS source FROM li""",
    "kw": """SELECT printf('img_%08d', o_orderkey) AS image_id, o_orderkey % 5 AS k, CASE o_orderkey % 5
            WHEN 0 THEN '소비기한' WHEN 1 THEN 'EXP' WHEN 2 THEN '제조일자' ELSE 'LOT' END AS text
        FROM orders WHERE o_orderkey % 5 < 4""",
    "tok": """SELECT image_id, rn AS token_index, text, conf, det, x1, y1, x2, y2, source FROM dt
        UNION ALL SELECT image_id, 0, text, 0.95, 0.9, 0.0, 20.0, 60.0, 38.0, 'baseline' FROM kw""",
    # ddOCTyyyy is misread: the O next to a digit is taken for a zero, so no date is found there
    "cand": """SELECT *, strftime(d, '%Y') AS year, strftime(d, '%m') AS month, strftime(d, '%d') AS day,
            strftime(d, '%Y-%m-%d') AS iso,
            CASE form WHEN 1 THEN 'ymd_separated' WHEN 2 THEN 'dmy_separated' WHEN 3 THEN 'ymd_compact'
                WHEN 4 THEN 'dmy_month_name' ELSE 'ymd_korean' END AS pattern,
            CASE form WHEN 1 THEN 1.0 WHEN 2 THEN 0.92 WHEN 3 THEN 0.9 WHEN 4 THEN 0.92 ELSE 1.0 END AS rel
        FROM dt WHERE NOT (form = 4 AND month(d) = 10)""",
    "ext": "SELECT image_id, min(d) AS mn, max(d) AS mx FROM cand GROUP BY image_id",
    "ctx": """SELECT c.*, e.mn, e.mx, k.k, CASE WHEN k.k IS NULL THEN 0.0 ELSE
            least(1.5, 1.0 / (1.0 + 4.0 * (sqrt((30.0 - (x1 + x2) / 2) ** 2 + (29.0 - (y1 + y2) / 2) ** 2)
                / greatest(1.0, x2, y2, 60.0, 38.0)))
            + CASE WHEN abs(29.0 - (y1 + y2) / 2) <= 18.0 THEN 0.15 WHEN (y1 + y2) / 2 >= 29.0 THEN 0.15 * 0.75
                ELSE 0.0 END) END AS spatial
        FROM cand c JOIN ext e USING (image_id) LEFT JOIN kw k USING (image_id)""",
    "feat": """SELECT *, CASE WHEN k IN (0, 1) THEN least(1.5, 1.0 / (1.0 + rn) + spatial) ELSE 0.0 END AS positive,
            CASE WHEN k IN (2, 3) THEN least(1.5, 1.0 / (1.0 + rn) + spatial) ELSE 0.0 END AS negative,
            mx > mn AND d = mx AS is_latest, mx > mn AND d = mn AS is_min FROM ctx""",
    "sc": """SELECT *, 0.2 * conf + 0.2 * det + 0.5 * 1.0 + 0.25 * rel + 0.7 * positive - 0.45 * negative
            + 0.25 * spatial + CASE WHEN is_latest THEN 0.15 WHEN is_min AND positive = 0 THEN 0.15 * -0.5
                ELSE 0.0 END + CASE WHEN form = 2 THEN 0.4 ELSE 0.0 END AS score FROM feat""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, rn) AS rank FROM sc""",
    "best": "SELECT * FROM ranked WHERE rank = 1",
    "img": """SELECT printf('img_%08d', o_orderkey) AS image_id, o_orderkey, o_orderstatus FROM orders""",
    "pred": """SELECT i.image_id, coalesce(year, 'NONE') AS year, coalesce(month, 'NONE') AS month,
            coalesce(day, 'NONE') AS day, coalesce(iso, 'NONE') AS final_date, coalesce(score, 0.0) AS confidence,
            b.text AS raw_text, b.pattern, b.rn, b.positive, b.conf FROM img i LEFT JOIN best b USING (image_id)""",
    "lab": """SELECT i.image_id, i.o_orderkey, CASE WHEN o_orderstatus = 'P' OR m.d IS NULL THEN 'NONE'
            ELSE strftime(m.d, '%Y-%m-%d') END AS final_date
        FROM img i LEFT JOIN (SELECT image_id, max(d) AS d FROM li GROUP BY image_id) m USING (image_id)""",
    "labp": """SELECT image_id, o_orderkey, CASE WHEN final_date = 'NONE' THEN 'NONE' ELSE final_date[1:4] END AS year,
            CASE WHEN final_date = 'NONE' THEN 'NONE' ELSE final_date[6:7] END AS month,
            CASE WHEN final_date = 'NONE' THEN 'NONE' ELSE final_date[9:10] END AS day, final_date FROM lab""",
    "ev": """SELECT p.image_id, p.final_date AS predicted, l.final_date AS target, p.year AS py, p.month AS pm,
            p.day AS pd, l.year AS ly, l.month AS lm, l.day AS ld, p.final_date = l.final_date AS ok,
            EXISTS (SELECT 1 FROM cand c WHERE c.image_id = p.image_id AND c.iso = l.final_date) AS covered,
            (SELECT count(*) FROM cand c WHERE c.image_id = p.image_id) AS n_cand,
            (SELECT count(*) FROM tok t WHERE t.image_id = p.image_id) AS n_tok
        FROM pred p JOIN labp l USING (image_id)""",
    "noisy0": """SELECT *, o_orderkey % 17 AS k, final_date <> 'NONE' AS dated FROM labp""",
    "noisy1": """SELECT image_id, k, dated, CASE WHEN dated AND k = 3 THEN '1995' ELSE year END AS year,
            CASE WHEN dated AND k = 1 THEN '13' WHEN dated AND k = 2 THEN '02' ELSE month END AS month,
            CASE WHEN dated AND k = 2 THEN '30' WHEN k = 6 AND NOT dated THEN '01' ELSE day END AS day FROM noisy0""",
    "noisy": """SELECT CASE WHEN k = 7 THEN '' ELSE image_id END AS image_id, k, dated, year, month,
            CASE WHEN dated AND k = 5 THEN '00' ELSE day END AS day,
            CASE WHEN NOT dated THEN 'NONE' WHEN k = 4 THEN year || '/' || month || '/' || day
                ELSE year || '-' || month || '-' || day END AS final_date FROM noisy1""",
    "det": """SELECT image_id, rn - 1 AS candidate_index, rn, d, CASE rn % 5
            WHEN 1 THEN strftime(d, '%Y.%m.%d') WHEN 2 THEN strftime(d, '%d/%m/%Y')
            WHEN 3 THEN strftime(d, '%Y%m%d') WHEN 4 THEN upper(strftime(d, '%d%b%Y'))
            ELSE strftime(d, '%Y년 %m월 %d일') END AS raw,
            CASE WHEN rn % 4 <> 0 THEN strftime(d + CASE WHEN rn % 3 = 0 THEN 1 ELSE 0 END, '%Y-%m-%d') END AS prediction,
            round(0.3 + l_discount * 6, 6) AS rec_score, round(0.2 + l_tax * 9, 6) AS det_conf, rn % 4 AS class,
            CAST(75 + 100 * ((rn - 1) % 2) AS DOUBLE) AS x1, CAST(20 * rn + 1 AS DOUBLE) AS y1,
            CAST(155 + 100 * ((rn - 1) % 2) AS DOUBLE) AS x2, CAST(20 * rn + 19 AS DOUBLE) AS y2 FROM li""",
    "box": """SELECT image_id, rn - 1 AS box_index, rn % 4 AS class, ['date','due','code','full'][rn % 4 + 1] AS name,
            (112 + 100 * ((rn - 1) % 2)) / 400.0::DOUBLE AS cx, (20 * rn + 10) / 300.0::DOUBLE AS cy,
            (80 + rn) / 400.0::DOUBLE AS width, 18 / 300.0::DOUBLE AS height,
            round(0.3 + l_tax * 8, 6) AS confidence FROM li""",
    "spl": """SELECT o_orderkey, printf('img_%08d', o_orderkey) AS image_id, CAST(o_orderdate AS DATE) + 9131 AS d
        FROM orders""",
    "run": """SELECT user_id, event_type, count(*) AS images, round(avg(value), 6) AS mean_value,
            round(max(value), 6) AS max_value, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS hits
        FROM events GROUP BY user_id, event_type""",
}

_USES = {
    "dt": ["li"], "tok": ["dt", "kw"], "cand": ["dt"], "ext": ["cand"], "ctx": ["cand", "ext", "kw"],
    "feat": ["ctx"], "sc": ["feat"], "ranked": ["sc"], "best": ["ranked"], "pred": ["img", "best"],
    "lab": ["img", "li"], "labp": ["lab"], "ev": ["pred", "labp", "cand", "tok"], "noisy0": ["labp"],
    "noisy1": ["noisy0"], "noisy": ["noisy1"], "det": ["li"], "box": ["li"],
}


def sql(body: str, *parts: str, **extra: str) -> str:
    """SELECT text with the named parts, and what they need, in front. Extra CTEs come last."""
    order: list[str] = []

    def visit(p: str) -> None:
        if p not in order:
            for q in _USES.get(p, []):
                visit(q)
            order.append(p)
    for p in parts:
        visit(p)
    ctes = [f"{p} AS ({PARTS[p]})" for p in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
