"""SQL for DuckDB of what several registered queries compare with, over the views of `adapters`.

Each text is a chain of common table expressions that starts with WITH. EXACT matches by equal numbers; WHOLE by equal
and fuzzy ones, where the greedy choice is a recursion over each supplier block's pairs in order; BANK likewise for
bank lines. RULES holds the drafts of the document rules over either.
"""

from __future__ import annotations

REC = """WITH kn AS (SELECT company_id, supplier_gstin, norm_invoice_no, arg_min(taxable + cgst + sgst + igst + cess, id) AS booked FROM books WHERE supplier_gstin <> '' GROUP BY 1, 2, 3),
rec AS (SELECT i.*, k.booked, CASE WHEN NOT supplier_filed THEN NULL WHEN doc_type = 'credit_note' THEN CASE WHEN o.booked IS NOT NULL THEN 'accept' END WHEN k.booked IS NULL THEN 'reject'
  WHEN abs(total - k.booked) > 100 THEN CASE WHEN doc_type <> 'credit_note' AND NOT (is_amendment AND coalesce(direction, '') = 'downward') THEN 'pending' ELSE 'reject' END ELSE 'accept' END AS action
  FROM inbox i LEFT JOIN kn k USING (company_id, supplier_gstin, norm_invoice_no) LEFT JOIN kn o ON o.company_id = i.company_id AND o.supplier_gstin = i.supplier_gstin AND o.norm_invoice_no = i.orig_norm_invoice_no)
"""
PCT = "CAST(CASE WHEN {w} = 0 THEN 0 ELSE round_even(CAST({p} AS DOUBLE) * 100 / {w}, {n}) END AS DOUBLE)"

AGEING = """WITH pd AS (SELECT DISTINCT company_id, period, last_day(CAST(period || '-01' AS DATE)) AS as_of FROM ledger),
m AS (SELECT l.company_id, pd.period, party_id, id, entry_date, voucher_type, debit, credit, as_of FROM ledger l JOIN pd ON pd.company_id = l.company_id AND entry_date <= as_of WHERE party_id IS NOT NULL),
w AS (SELECT *, coalesce(sum(credit) FILTER (WHERE voucher_type = 'Receipt') OVER (PARTITION BY company_id, period, party_id), 0) AS paid,
  coalesce(sum(debit) FILTER (WHERE voucher_type = 'Sales') OVER (PARTITION BY company_id, period, party_id ORDER BY entry_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
o AS (SELECT company_id, period, party_id, debit - greatest(0, least(debit, paid - before)) AS open, date_diff('day', entry_date, as_of) AS age FROM w WHERE voucher_type = 'Sales' AND debit > 0),
a AS (SELECT company_id, period, CAST(sum(open) AS BIGINT) AS total, CAST(coalesce(sum(open) FILTER (WHERE age > 90), 0) AS BIGINT) AS aged FROM o GROUP BY 1, 2)
"""

COMPARABLE = """WITH cmp AS (SELECT * FROM portal p WHERE section IN ('B2B', 'B2BA') AND NOT (section = 'B2B' AND EXISTS (SELECT 1 FROM portal q WHERE q.section = 'B2BA'
  AND q.company_id = p.company_id AND q.supplier_gstin = p.supplier_gstin AND q.amends_invoice_no = p.norm_invoice_no))),
"""

#: Score in thousandths, half to even, of q ten-thousandths of number likeness; the agreements; the category.
SCORED = """raw AS (SELECT b.company_id, b.period AS lp, r.period AS rp, b.supplier_gstin AS g, b.norm_invoice_no AS no, b.id AS l_id, r.id AS r_id, b.taxable - r.taxable AS amount_delta,
  date_diff('day', r.invoice_date, b.invoice_date) AS date_delta_days, pr.q, CAST(greatest(abs(b.taxable), 100) AS HUGEINT) AS s,
  CAST(b.norm_invoice_no = r.norm_invoice_no AS INT) AS k0, CAST(b.invoice_date = r.invoice_date AS INT) AS k1, CAST(abs(b.taxable - r.taxable) <= 100 AS INT) AS k2,
  CAST(abs(b.cgst + b.sgst + b.igst + b.cess - r.cgst - r.sgst - r.igst - r.cess) <= 100 AS INT) AS k3,
  CAST(abs(b.cgst - r.cgst) <= 100 AND abs(b.sgst - r.sgst) <= 100 AND abs(b.igst - r.igst) <= 100 AND abs(b.cess - r.cess) <= 100 AS INT) AS k4
  FROM books b JOIN pr ON b.company_id = pr.c AND b.supplier_gstin = pr.g AND b.norm_invoice_no = pr.ln JOIN cmp r ON r.company_id = pr.c AND r.supplier_gstin = pr.g AND r.norm_invoice_no = pr.rn),
num AS (SELECT *, 135000 * s + 9 * q * s + 45000 * greatest(0, s - abs(amount_delta)) + 1000 * greatest(0, 30 - abs(date_delta_days)) * s AS n, 300 * s AS d FROM raw),
sc AS (SELECT *, CAST(n // d + CASE WHEN 2 * (n % d) > d OR (2 * (n % d) = d AND (n // d) % 2 = 1) THEN 1 ELSE 0 END AS INT) AS score_milli,
  CASE WHEN k0 + k1 + k2 + k3 + k4 = 5 THEN 'exact' WHEN k0 + k1 + k2 + k3 + k4 = 4 THEN 'partial' WHEN k0 = 1 AND k1 = 1 THEN 'value_mismatch' ELSE 'fuzzy' END AS category FROM num),
"""

EQUAL = "pr AS (SELECT DISTINCT company_id AS c, supplier_gstin AS g, norm_invoice_no AS ln, norm_invoice_no AS rn, 10000 AS q FROM books WHERE supplier_gstin <> ''),\n"

#: The three likest numbers of a block for each left number, at 60 of 100 at least; an equal one takes a place.
#: The longest common subsequence is counted in the bits of an integer.
LIKE = """ln AS (SELECT DISTINCT company_id AS c, supplier_gstin AS g, norm_invoice_no AS l FROM books WHERE supplier_gstin <> '' AND norm_invoice_no <> ''),
rn AS (SELECT DISTINCT company_id AS c, supplier_gstin AS g, norm_invoice_no AS r FROM cmp WHERE supplier_gstin <> '' AND norm_invoice_no <> ''),
bits AS (SELECT c, g, l, r, CAST(length(l) AS BIGINT) AS m, (CAST(1 AS BIGINT) << length(l)) - 1 AS f,
  list_transform(string_split(r, ''), lambda ch: list_sum(list_transform(range(length(l)), lambda i: CASE WHEN l[i + 1] = ch THEN CAST(1 AS BIGINT) << i ELSE CAST(0 AS BIGINT) END))) AS hits FROM ln JOIN rn USING (c, g)),
lcs AS (SELECT c, g, l, r, m - bit_count(list_reduce(list_prepend(f, list_transform(hits, lambda h: CAST(h AS BIGINT))), lambda w, h: ((w + (w & h)) | (w - (w & h))) & f)) AS n FROM bits),
rated AS (SELECT *, 200.0::DOUBLE * n / (length(l) + length(r)) AS ratio FROM lcs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c, g, l ORDER BY ratio DESC, r) AS k FROM rated WHERE ratio >= 60),
pr AS (SELECT DISTINCT company_id AS c, supplier_gstin AS g, norm_invoice_no AS ln, norm_invoice_no AS rn, 10000 AS q FROM books WHERE supplier_gstin <> ''
  UNION ALL SELECT c, g, l, r, CAST(round_even(ratio * 100, 0) AS INT) FROM ranked WHERE k <= 3 AND ratio < 100),
"""

GREEDY = """ord AS (SELECT *, row_number() OVER (PARTITION BY company_id, g ORDER BY score_milli DESC, l_id, r_id) AS nth FROM sc WHERE score_milli >= 700),
pick AS (SELECT DISTINCT company_id, g, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, CAST(NULL AS BIGINT) AS l_id, CAST(NULL AS BIGINT) AS r_id, false AS took FROM ord
  UNION ALL SELECT o.company_id, o.g, o.nth, CASE WHEN NOT list_contains(ls, o.l_id) AND NOT list_contains(rs, o.r_id) THEN list_append(ls, o.l_id) ELSE ls END,
    CASE WHEN NOT list_contains(ls, o.l_id) AND NOT list_contains(rs, o.r_id) THEN list_append(rs, o.r_id) ELSE rs END, o.l_id, o.r_id, NOT list_contains(ls, o.l_id) AND NOT list_contains(rs, o.r_id)
  FROM pick p JOIN ord o ON o.company_id = p.company_id AND o.g = p.g AND o.nth = p.nth + 1),
mt AS (SELECT ord.* FROM ord JOIN pick ON pick.took AND ord.l_id = pick.l_id AND ord.r_id = pick.r_id),
"""

FIRST = "mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY score_milli DESC, l_id) AS nth FROM sc WHERE score_milli >= 700) WHERE nth = 1),\n"

STATE = """st AS (SELECT b.*, m.category, m.r_id, m.rp, m.score_milli, m.amount_delta, m.date_delta_days, CASE WHEN m.l_id IS NOT NULL THEN 'matched' WHEN EXISTS (SELECT 1 FROM mt c WHERE c.company_id = b.company_id AND c.g = b.supplier_gstin AND c.no = b.norm_invoice_no) THEN 'duplicate' ELSE 'unmatched' END AS status
  FROM books b LEFT JOIN mt m ON m.l_id = b.id)"""

RULES = """,
dl AS (SELECT st.*, make_date(CASE WHEN month(invoice_date) >= 4 THEN year(invoice_date) ELSE year(invoice_date) - 1 END + 1, 11, 30) AS deadline FROM st),
lp AS (SELECT company_id, max(period) AS latest FROM periods GROUP BY 1),
r1 AS (SELECT company_id, period, 'R1' AS rule_code, 'R1:' || coalesce(supplier_gstin, 'no-gstin-' || CAST(id AS VARCHAR)) || ':' || norm_invoice_no AS risk_key, CASE WHEN date_diff('day', DATE '2001-09-01', deadline) <= 60 OR age >= 3 THEN 'high' WHEN age >= 2 THEN 'medium' ELSE 'low' END AS severity,
  cgst + sgst + igst + cess AS headline, deadline, id FROM (SELECT *, (CAST(substring(latest, 1, 4) AS INT) * 12 + CAST(substring(latest, 6, 2) AS INT)) - (CAST(substring(period, 1, 4) AS INT) * 12 + CAST(substring(period, 6, 2) AS INT)) AS age FROM dl JOIN lp USING (company_id) WHERE status = 'unmatched')),
r2 AS (SELECT b.company_id, b.period, 'R2' AS rule_code, 'R2:' || b.supplier_gstin || ':' || b.norm_invoice_no AS risk_key, 'medium' AS severity, abs(b.taxable - p.taxable) AS headline, b.id, p.id AS p_id FROM st b JOIN portal p ON p.id = b.r_id
  WHERE abs(b.taxable - p.taxable) > 100 OR abs(b.cgst - p.cgst) > 100 OR abs(b.sgst - p.sgst) > 100 OR abs(b.igst - p.igst) > 100 OR abs(b.cess - p.cess) > 100),
r3 AS (SELECT company_id, period, 'R3' AS rule_code, 'R3:' || supplier_gstin || ':' || norm_invoice_no AS risk_key, 'high' AS severity, taxable + cgst + sgst + igst + cess AS headline, id FROM st WHERE status = 'duplicate'
  AND NOT EXISTS (SELECT 1 FROM portal q WHERE q.section IN ('B2BA', 'CDNRA') AND q.company_id = st.company_id AND q.supplier_gstin = st.supplier_gstin AND q.norm_invoice_no = st.norm_invoice_no)),
dr AS (SELECT company_id, period, rule_code, risk_key, severity, headline FROM r1 UNION ALL SELECT company_id, period, rule_code, risk_key, severity, headline FROM r2 UNION ALL SELECT company_id, period, rule_code, risk_key, severity, headline FROM r3)
"""

EXACT = COMPARABLE + EQUAL + SCORED + FIRST + STATE + RULES
WHOLE = COMPARABLE + LIKE + SCORED + GREEDY + STATE + RULES

BANK_STATE = """bl AS (SELECT company_id, id AS b_id, txn_date AS b_day, coalesce(credit, debit) AS b_paise, CASE WHEN credit IS NOT NULL THEN 'in' ELSE 'out' END AS direction, coalesce(party_id, -1) AS party FROM bank WHERE credit IS NOT NULL OR debit IS NOT NULL),
vl AS (SELECT company_id, id AS v_id, entry_date AS v_day, CASE WHEN voucher_type = 'Receipt' THEN credit ELSE debit END AS v_paise, CASE WHEN voucher_type = 'Receipt' THEN 'in' ELSE 'out' END AS direction, coalesce(party_id, -1) AS party FROM ledger
  WHERE (voucher_type = 'Receipt' AND credit IS NOT NULL) OR (voucher_type = 'Payment' AND debit IS NOT NULL)),
bp AS (SELECT company_id, direction, party, b_id, v_id, abs(date_diff('day', v_day, b_day)) AS gap, row_number() OVER (PARTITION BY company_id, direction, party ORDER BY b_day, b_id, abs(date_diff('day', v_day, b_day)), v_paise - b_paise, v_day, v_id) AS nth
  FROM bl JOIN vl USING (company_id, direction, party) WHERE abs(v_paise - b_paise) <= 100 AND abs(date_diff('day', v_day, b_day)) <= 5),
bk AS (SELECT DISTINCT company_id, direction, party, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS bs, CAST([] AS BIGINT[]) AS vs, CAST(NULL AS BIGINT) AS b_id, CAST(NULL AS BIGINT) AS v_id, CAST(NULL AS BIGINT) AS gap, false AS took FROM bp
  UNION ALL SELECT o.company_id, o.direction, o.party, o.nth, CASE WHEN NOT list_contains(bs, o.b_id) AND NOT list_contains(vs, o.v_id) THEN list_append(bs, o.b_id) ELSE bs END,
    CASE WHEN NOT list_contains(bs, o.b_id) AND NOT list_contains(vs, o.v_id) THEN list_append(vs, o.v_id) ELSE vs END, o.b_id, o.v_id, o.gap, NOT list_contains(bs, o.b_id) AND NOT list_contains(vs, o.v_id)
  FROM bk p JOIN bp o ON o.company_id = p.company_id AND o.direction = p.direction AND o.party = p.party AND o.nth = p.nth + 1),
bm AS (SELECT company_id, 'bank_txn' AS left_type, b_id AS left_id, v_id AS right_id, 'matched' AS status, CASE WHEN gap = 0 AND party >= 0 THEN 'strong' ELSE 'amount_date' END AS method, CAST(CASE WHEN gap = 0 AND party >= 0 THEN 1.0 ELSE 0.85 END AS DOUBLE) AS score, CAST(gap AS INT) AS gap FROM bk WHERE took
  UNION ALL SELECT company_id, 'bank_txn', b_id, NULL, 'unmatched', 'none', NULL, NULL FROM bl WHERE b_id NOT IN (SELECT b_id FROM bk WHERE took)
  UNION ALL SELECT company_id, 'ledger_entry', v_id, NULL, 'unmatched', 'none', NULL, NULL FROM vl WHERE v_id NOT IN (SELECT v_id FROM bk WHERE took))"""

VARIANCE = """,
vr AS (SELECT company_id, period, CAST(sum(books_net) AS BIGINT) AS books_net, CAST(sum(timing) AS BIGINT) AS timing, CAST(sum(books_only) AS BIGINT) AS books_only, CAST(sum(bank_net) AS BIGINT) AS bank_net, CAST(sum(bank_in_only) AS BIGINT) AS bank_in_only,
    CAST(sum(bank_out_only) AS BIGINT) AS bank_out_only, CAST(sum(turnover) AS BIGINT) AS turnover FROM (
  SELECT l.company_id, l.period, sg AS books_net, CASE WHEN b.period <> l.period THEN sg ELSE 0 END AS timing, CASE WHEN u.left_id IS NOT NULL THEN sg ELSE 0 END AS books_only, 0 AS bank_net, 0 AS bank_in_only, 0 AS bank_out_only, CASE WHEN voucher_type = 'Sales' THEN coalesce(l.debit, 0) ELSE 0 END AS turnover
    FROM (SELECT *, CASE voucher_type WHEN 'Receipt' THEN coalesce(credit, 0) WHEN 'Payment' THEN -coalesce(debit, 0) ELSE 0 END AS sg FROM ledger) l LEFT JOIN bm m ON m.status = 'matched' AND m.right_id = l.id LEFT JOIN bank b ON b.id = m.left_id LEFT JOIN bm u ON u.left_type = 'ledger_entry' AND u.left_id = l.id
  UNION ALL SELECT b.company_id, b.period, 0, 0, 0, coalesce(credit, 0) - coalesce(debit, 0), CASE WHEN m.status = 'unmatched' THEN coalesce(credit, 0) ELSE 0 END, CASE WHEN m.status = 'unmatched' THEN coalesce(debit, 0) ELSE 0 END, 0 FROM bank b LEFT JOIN bm m ON m.left_type = 'bank_txn' AND m.left_id = b.id) GROUP BY 1, 2),
vp AS (SELECT *, books_net - bank_net AS variance, books_net - bank_net - (timing + bank_out_only - bank_in_only + books_only) AS residual FROM vr)
"""

BANK = "WITH " + BANK_STATE + VARIANCE

NUMBERED = "coalesce(nullif(supplier_gstin, ''), 'no-gstin-' || CAST(id AS VARCHAR)) || ':' || norm_invoice_no"

#: The drafts of all rules (fb) and of those that are on by default (fx), and the findings of either (fa, fo): one a key.
DRAFTS = (
    WHOLE + ", " + BANK_STATE + VARIANCE + ", " + AGEING.removeprefix("WITH ").rstrip() + ", " + REC.removeprefix("WITH ").rstrip()
    + f""",
r5p AS (SELECT *, {PCT.format(p="abs(variance)", w="turnover", n=2)} AS pct FROM vp),
r7p AS (SELECT company_id, period, party_id, amount, row_number() OVER (PARTITION BY company_id, period ORDER BY amount DESC, party_id) AS n FROM (SELECT company_id, period, party_id, sum(debit) AS amount FROM ledger WHERE voucher_type = 'Sales' GROUP BY 1, 2, 3)),
r7s AS (SELECT *, {PCT.format(p="t", w="w", n=2)} AS pct FROM (SELECT company_id, period, sum(amount) AS w, sum(amount) FILTER (WHERE n <= 3) AS t FROM r7p GROUP BY 1, 2)),
r8s AS (SELECT *, {PCT.format(p="aged", w="total", n=2)} AS pct FROM a WHERE total > 0),
fb AS (
SELECT company_id, period, rule_code, risk_key, severity, CAST(headline AS BIGINT) AS headline, CAST(NULL AS DOUBLE) AS pct, 'purchase_invoice' AS record_type, id AS record_id FROM r1
UNION ALL SELECT company_id, period, rule_code, risk_key, severity, headline, NULL, 'purchase_invoice', id FROM r2
UNION ALL SELECT company_id, period, rule_code, risk_key, severity, headline, NULL, 'purchase_invoice', id FROM r3
UNION ALL SELECT company_id, period, 'R4', 'R4:' || {NUMBERED}, CASE WHEN date_diff('day', DATE '2001-09-01', make_date(CASE WHEN month(invoice_date) >= 4 THEN year(invoice_date) ELSE year(invoice_date) - 1 END + 1, 11, 30)) <= 60 THEN 'high' ELSE 'medium' END, reversal, NULL, 'gstr2b_line', id FROM portal WHERE reversal > 0
UNION ALL SELECT company_id, period, 'R4b', 'R4b:' || {NUMBERED}, 'info', reversal, NULL, 'gstr2b_line', id FROM portal g WHERE reversal > 0 AND EXISTS (SELECT 1 FROM portal x WHERE x.company_id = g.company_id AND x.supplier_gstin = g.supplier_gstin AND x.reversal = 0 AND x.period > g.period)
UNION ALL SELECT company_id, period, 'R5', 'R5:bank_books_variance', CASE WHEN pct > 1 AND abs(residual) > 5000000 THEN 'high' ELSE 'medium' END, abs(variance), pct, NULL, NULL FROM r5p WHERE pct > 1 OR abs(residual) > 5000000
UNION ALL SELECT company_id, period, 'R6', 'R6:' || CAST(id AS VARCHAR), 'medium', credit, NULL, 'bank_txn', id FROM bank WHERE credit >= 5000000 AND party_id IS NULL AND id IN (SELECT left_id FROM bm WHERE left_type = 'bank_txn' AND status = 'unmatched')
UNION ALL SELECT company_id, period, 'R7', 'R7:customer_concentration', CASE WHEN pct > 65 THEN 'high' ELSE 'medium' END, CAST(t AS BIGINT), pct, NULL, NULL FROM r7s WHERE pct > 50
UNION ALL SELECT company_id, period, 'R8', 'R8:receivables_ageing', CASE WHEN pct > 40 THEN 'high' ELSE 'medium' END, aged, pct, NULL, NULL FROM r8s WHERE pct > 20
UNION ALL SELECT company_id, period, 'R9', 'R9:deemed_accepted', CASE WHEN count(*) FILTER (WHERE action = 'reject') > 0 THEN 'high' WHEN count(*) FILTER (WHERE action = 'pending') > 0 THEN 'medium' ELSE 'low' END, CAST(sum(total) AS BIGINT), NULL, NULL, NULL FROM rec WHERE portal_status = 'no_action' GROUP BY 1, 2
UNION ALL SELECT company_id, period, 'R10', 'R10:' || {NUMBERED}, 'high', total, NULL, 'ims_record', id FROM rec WHERE action = 'reject' OR (doc_type = 'credit_note' AND action IS NULL AND supplier_filed)
UNION ALL SELECT company_id, period, 'R11', 'R11:recompute_required', 'high', count(*), NULL, NULL, NULL FROM inbox WHERE day(actioned_at) > 14 GROUP BY 1, 2
UNION ALL SELECT f.company_id, f.period, 'R12', 'R12:filing_chain', 'high', 0, NULL, NULL, NULL FROM filings f JOIN filings b ON b.company_id = f.company_id AND strftime(CAST(b.period || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') = f.period AND NOT b.filed
UNION ALL SELECT company_id, period, 'R13', 'R13:' || {NUMBERED}, 'medium', cgst + sgst + igst + cess, NULL, 'gstr2b_line', id FROM portal WHERE NOT itc_available),
fa AS (SELECT * EXCLUDE (nth_of_key) FROM (SELECT *, row_number() OVER (PARTITION BY company_id, period, risk_key ORDER BY record_id DESC NULLS LAST) AS nth_of_key FROM fb) WHERE nth_of_key = 1),
fx AS (SELECT * FROM fb WHERE rule_code IN ('R1', 'R2', 'R3', 'R4', 'R5', 'R6', 'R7', 'R8')),
fo AS (SELECT * FROM fa WHERE rule_code IN ('R1', 'R2', 'R3', 'R4', 'R5', 'R6', 'R7', 'R8')),
ev AS (SELECT company_id, period, rule_code, risk_key, 0 AS nth, record_type, record_id FROM fa WHERE record_id IS NOT NULL
UNION ALL SELECT fa.company_id, fa.period, fa.rule_code, fa.risk_key, 1, 'gstr2b_line', p_id FROM fa JOIN r2 ON fa.rule_code = 'R2' AND r2.id = fa.record_id
UNION ALL SELECT s.company_id, s.period, 'R7', 'R7:customer_concentration', CAST(n - 1 AS INT), 'party', party_id FROM r7s s JOIN r7p p ON p.company_id = s.company_id AND p.period = s.period AND n <= 3 WHERE pct > 50
UNION ALL SELECT company_id, period, 'R8', 'R8:receivables_ageing', CAST(k - 1 AS INT), 'party', party_id FROM (SELECT s.company_id, s.period, p.party_id, row_number() OVER (PARTITION BY s.company_id, s.period ORDER BY p.aged DESC, p.party_id) AS k
  FROM r8s s JOIN (SELECT company_id, period, party_id, sum(open) AS aged FROM o WHERE age > 90 GROUP BY 1, 2, 3) p ON p.company_id = s.company_id AND p.period = s.period AND p.aged > 0 WHERE pct > 20) WHERE k <= 5)
"""
)
