"""The fixture mapping of ``rollbook.sources.fixtures`` written once more as
DuckDB SQL: a CTE prefix over the driver's pre-registered views, so each
oracle statement is ``WITH <fixtures> <query>``.  Only integer arithmetic,
no hash functions; string concatenation uses ``||`` (NULL-propagating).
"""

from __future__ import annotations

FIXTURE_CTES = r"""
cy AS (
  SELECT ck, y FROM (SELECT c_custkey AS ck, unnest(range(7)) AS y FROM customer)
  WHERE (ck + y) % 4 <> 3
),
academic_years AS (
  SELECT 7001 + y AS academic_year_id,
         printf('%d-%02d', 1995 + y, (1996 + y) % 100) AS year_name,
         make_date(1995 + y, 1, 1) AS start_date,
         make_date(1995 + y, 12, 31) AS end_date,
         y = 5 AS is_active, y < 5 AS is_closed,
         CAST(make_date(1995 + y, 1, 1) AS TIMESTAMP) AS created_at
  FROM range(7) t(y)
),
users AS (
  SELECT 1001 + c_custkey AS user_id, 'S' || CAST(c_custkey AS VARCHAR) AS username,
         'student' AS role,
         CASE WHEN c_custkey % 13 = 0 THEN 'inactive' ELSE 'active' END AS status,
         CAST(DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM customer
  UNION ALL
  SELECT 10000001 + s_suppkey, 'E' || CAST(s_suppkey AS VARCHAR),
         CASE WHEN s_suppkey % 10 = 9 THEN 'accountant' ELSE 'teacher' END,
         CASE WHEN s_suppkey % 13 = 0 THEN 'inactive' ELSE 'active' END,
         CAST(DATE '2000-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS TIMESTAMP)
  FROM supplier
  UNION ALL
  SELECT CAST(1 AS BIGINT), 'admin', 'admin', 'active', TIMESTAMP '2000-01-01 00:00:00'
),
employees AS (
  SELECT 2001 + s_suppkey AS employee_id, 10000001 + s_suppkey AS user_id, s_name AS fname,
         CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'N' || CAST(s_nationkey AS VARCHAR) END AS lname,
         'E' || CAST(s_suppkey AS VARCHAR) AS reg_no,
         CASE s_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
         'M' || CAST(s_suppkey AS VARCHAR) AS mobile,
         'e' || CAST(s_suppkey AS VARCHAR) || '@x' AS email,
         DATE '1990-01-01' + CAST(s_suppkey AS INTEGER) AS joining_date,
         CAST(s_acctbal AS DECIMAL(10,2)) AS salary
  FROM supplier
),
classes AS (
  SELECT 3001 + i AS class_id, CAST(1 + (i % 30) // 3 AS INTEGER) AS class_level,
         CASE i % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS division,
         7001 + i // 30 AS academic_year_id,
         CASE WHEN i % 7 = 0 THEN NULL ELSE 2001 + i % 9 END AS class_teacher_id
  FROM range(210) t(i)
),
student_master AS (
  SELECT 301 + c_custkey AS student_master_id, 'S' || CAST(c_custkey AS VARCHAR) AS reg_no,
         c_name AS fname,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS lname,
         CAST(NULL AS VARCHAR) AS mother_name,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
         DATE '1985-01-01' + CAST(c_custkey % 3650 AS INTEGER) AS dob,
         'M' || CAST(c_custkey AS VARCHAR) AS mobile,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 's' || CAST(c_custkey AS VARCHAR) || '@x' END AS email,
         c_mktsegment AS address,
         TIMESTAMP '2000-01-01 00:00:00' AS created_at
  FROM customer
),
student_enrollments AS (
  SELECT 501 + 7 * ck + y AS enrollment_id, 301 + ck AS student_master_id,
         7001 + y AS academic_year_id,
         3001 + 30 * y + 3 * ((ck + y) % 10) + ck % 3 AS class_id,
         CAST(1 + ck AS INTEGER) AS roll_no,
         make_date(1995 + y, 1, 1) AS admission_date,
         CASE WHEN ck % 11 = 0 THEN NULL ELSE 1001 + ck END AS user_id,
         CASE WHEN (ck + y) % 17 = 0 THEN 'left' WHEN (ck + y) % 19 = 0 THEN 'failed'
              ELSE 'active' END AS status
  FROM cy
),
subjects AS (
  SELECT 5001 + i AS subject_id,
         CASE i % 5 WHEN 0 THEN 'Maths' WHEN 1 THEN 'Science' WHEN 2 THEN 'English'
                    WHEN 3 THEN 'History' ELSE 'Art' END AS subject_name,
         3001 + i // 5 AS class_id, 2001 + i % 9 AS teacher_id, 7001 + i // 150 AS academic_year_id
  FROM range(1050) t(i) WHERE (i // 5) % 30 <> 29
),
exams AS (
  SELECT 8001 + i AS exam_id,
         CASE i % 3 WHEN 0 THEN 'Unit Test' WHEN 1 THEN 'Midterm' ELSE 'Final' END AS exam_name,
         7001 + i // 3 AS academic_year_id
  FROM range(21) t(i)
),
fee_structures AS (
  SELECT 1501 + i AS structure_id, CAST(i % 10 + 1 AS INTEGER) AS class_level,
         7001 + i // 10 AS academic_year_id,
         CAST(40000 + 30000 * (i % 10 + 1) AS DECIMAL(10,2)) AS total_amount
  FROM range(70) t(i) WHERE i <> 59
),
order_enr AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority, cy.y,
         501 + 7 * o.o_custkey + cy.y AS enrollment_id
  FROM orders o JOIN cy ON cy.ck = o.o_custkey AND cy.y = year(o.o_orderdate) - 1995
),
fee_payments AS (
  SELECT 3501 + o_orderkey AS payment_id, enrollment_id,
         CAST(o_totalprice AS DECIMAL(10,2)) AS amount_paid,
         CAST(o_orderdate AS DATE) AS payment_date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'UPI' WHEN '5-LOW' THEN 'Bank' ELSE 'Cash' END
           AS payment_mode,
         'RCP' || CAST(o_orderkey AS VARCHAR) AS receipt_no
  FROM order_enr
),
mark_slots AS (
  SELECT oe.enrollment_id, oe.o_custkey AS ck, oe.y,
         30 * oe.y + 3 * ((oe.o_custkey + oe.y) % 10) + oe.o_custkey % 3 AS ord,
         l.l_partkey % 5 AS k, l.l_linenumber % 3 AS e, max(l.l_quantity) AS q
  FROM order_enr oe JOIN lineitem l ON l.l_orderkey = oe.o_orderkey
  WHERE 3 * ((oe.o_custkey + oe.y) % 10) + oe.o_custkey % 3 <> 29
  GROUP BY ALL
),
marks_raw AS (
  SELECT 100 * enrollment_id + 10 * k + e AS mark_id, enrollment_id,
         5001 + 5 * ord + k AS subject_id, 8001 + 3 * y + e AS exam_id,
         CAST(CASE WHEN (ck + k) % 29 = 0 THEN NULL ELSE 2 * q END AS DECIMAL(5,2)) AS marks_obtained,
         CAST(100 AS DECIMAL(5,2)) AS max_marks
  FROM mark_slots
),
marks AS (
  SELECT mark_id, enrollment_id, subject_id, exam_id, marks_obtained, max_marks,
         CASE WHEN max_marks IS NULL OR max_marks <= 0 THEN NULL
              WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 90 THEN 'A+'
              WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 80 THEN 'A'
              WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 70 THEN 'B'
              WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 60 THEN 'C'
              WHEN coalesce(marks_obtained, 0) * 100 >= max_marks * 40 THEN 'D'
              ELSE 'F' END AS grade
  FROM marks_raw
),
attendance_students AS (
  SELECT 100 * (506 + 7 * user_id) + day(d) AS attendance_id, 506 + 7 * user_id AS enrollment_id,
         d AS attendance_date,
         CASE WHEN bool_or(event_type = 'error') THEN 'Absent' ELSE 'Present' END AS status
  FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_type FROM events
        WHERE user_id IN (SELECT ck FROM cy WHERE y = 5))
  GROUP BY user_id, d
),
student_fee_assignments AS (
  SELECT 2 * se.enrollment_id + cp.copy AS assignment_id, se.enrollment_id, fs.total_amount,
         ay.start_date AS assigned_date
  FROM student_enrollments se
  JOIN classes c ON c.class_id = se.class_id
  JOIN fee_structures fs ON fs.class_level = c.class_level AND fs.academic_year_id = se.academic_year_id
  JOIN academic_years ay ON ay.academic_year_id = se.academic_year_id
  JOIN (SELECT 0 AS copy UNION ALL SELECT 1) cp ON cp.copy = 0 OR se.enrollment_id % 50 = 1
  WHERE se.enrollment_id % 9 <> 0
)
"""


def with_fixtures(body: str) -> str:
    """An oracle statement: the fixture CTEs, optional extra CTEs, then the query.

    ``body`` either starts with ``,`` (more CTEs, then the final SELECT) or is the SELECT itself.
    """
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return "WITH " + FIXTURE_CTES.strip() + sep + body
