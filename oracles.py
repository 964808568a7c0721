"""DuckDB statements for the registered queries.

Each statement starts from the test tables, builds the domain tables it needs as
CTEs and asks the question in plain SQL, without looking at how the Spark side
gets there.
"""

from __future__ import annotations

import re

# Domain tables as projections of the test tables.
TABLES = {
    "dispense": """
        SELECT CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS PatPharmSysID,
               CAST(o_orderkey AS VARCHAR) AS OriginalScriptNumber,
               o_orderkey * 10 + l_linenumber AS ScriptNo,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE p_name END AS Drugname,
               p_brand AS BrandName,
               CASE p_type WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN '' ELSE p_type END AS DrugSchedule,
               CAST(o_custkey % 10 AS INT) AS StoreId,
               CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 6 AS INT) END AS TotalRepeats,
               CAST(l_linenumber - 1 AS INT) AS RepeatNo,
               l_shipdate AS DispensedDate,
               o_orderdate AS DatePrescribed,
               CAST(l_extendedprice AS VARCHAR) AS DrugVal,
               p_retailprice AS PatientPrice
        FROM lineitem
        JOIN (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS drug FROM orders)
          ON l_orderkey = o_orderkey
        JOIN part ON p_partkey = drug""",
    "stores": """
        SELECT CAST(CASE WHEN s_suppkey = 9 THEN -9 ELSE s_suppkey END AS INT) AS PharmacyID,
               CASE WHEN s_suppkey % 3 = 0 THEN 'CHEMIST Discount Centre ' || n_name ELSE s_name END AS CommercialName,
               n_name AS TimeZoneState,
               CASE WHEN s_suppkey % 4 = 1 THEN 1 WHEN s_suppkey % 4 = 2 THEN NULL ELSE 0 END AS ExcludeHC,
               CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 1 END AS BIRExtractionFlag,
               s_name AS ContactPerson1
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "patients": """
        SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS dispenseid,
               c_custkey % 10 AS storeid,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Female' WHEN 'MACHINERY' THEN 'male'
                    WHEN 'FURNITURE' THEN 'MALE' WHEN 'BUILDING' THEN NULL ELSE 'Unknown' END AS gender
        FROM customer""",
    "contacts": """
        SELECT DISTINCT dispenseid AS patientid, storeid,
               'patient' || dispenseid || '@example.com' AS contactemail
        FROM patients WHERE dispenseid IS NOT NULL""",
    "sales": """
        SELECT CAST(o_custkey % 10 AS VARCHAR) AS StoreId, o_orderdate AS SalesDate FROM orders""",
    "stock": """
        SELECT DISTINCT CAST(l_suppkey % 10 AS VARCHAR) AS StoreId, l_partkey AS StockID FROM lineitem""",
    "ean_links": """
        SELECT CAST(l_suppkey % 10 AS VARCHAR) AS StoreId, l_partkey AS EAN FROM lineitem""",
    "wh_patients": """
        SELECT CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE CAST(c_custkey % 10 AS VARCHAR) END AS StoreId,
               c_custkey AS PatientId
        FROM customer""",
    "errors": """
        SELECT CAST(user_id % 10 AS VARCHAR) AS PharmacyId, event_id AS ErrorID,
               CASE WHEN event_type = 'error' THEN 'E' ELSE 'W' END AS ErrorIndicator,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS ErrorTypeUDC,
               CASE event_id % 3 WHEN 0 THEN 'BIR' WHEN 1 THEN 'SYNC' END AS ErrorSource,
               CASE event_id % 5
                    WHEN 0 THEN 'SQLite error no such table: Department_POS'
                    WHEN 1 THEN 'bulk copy failed for batch ' || CAST(event_id AS VARCHAR)
                    WHEN 2 THEN 'no such table: Department_X ' || props
                    WHEN 4 THEN 'Timeout while reading from the store gateway, retry scheduled after '
                                || props || ' attempts' END AS ErrorMessage,
               event_type AS TableName,
               ts AS ErrorDate
        FROM events""",
    "pings": """
        SELECT CASE WHEN user_id % 10 = 2 THEN NULL ELSE CAST(user_id % 10 AS INT) END AS StoreId,
               ts - INTERVAL '10 minutes' * CAST(user_id % 10 AS INT) AS ping
        FROM events""",
    "users": """
        SELECT c_custkey AS Userid, c_name AS Username,
               'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email,
               c_mktsegment AS Firstname, 'Family' || CAST(c_custkey AS VARCHAR) AS Lastname,
               CASE WHEN c_custkey % 5 = 0 THEN 'Inactive' ELSE 'Active' END AS Status,
               CASE WHEN c_custkey % 5 = 0 THEN 'SUS20' ELSE 'SUS10' END AS StatusUDC,
               CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS IsSuperAdmin,
               CAST(1 + c_custkey % 6 AS INT) AS RoleID,
               TIMESTAMP '2024-01-01 08:00:00' + INTERVAL '1 day' * CAST(c_custkey % 365 AS INT) AS CreatedDate,
               CAST(NULL AS TIMESTAMP) AS UpdatedDate
        FROM customer""",
    "roles": """
        SELECT r.RoleID, r.RoleName, r.RoleDescription, 1 AS IsActive
        FROM (VALUES
            (1, 'Super Admin', 'Full system access with all permissions'),
            (2, 'Pharmacy Manager', 'Manage pharmacy operations and view reports'),
            (3, 'Data Analyst', 'Access to analytics and reporting features'),
            (4, 'Support Staff', 'Basic access with support chat capabilities'),
            (5, 'Viewer', 'Read-only access to dashboard and basic features')
        ) AS r(RoleID, RoleName, RoleDescription)
        WHERE r.RoleID IN (SELECT 1 + c_custkey % 6 FROM customer)""",
    "permissions": """
        SELECT p.*, 1 AS IsActive
        FROM (VALUES
            (1, 'VIEW_DASHBOARD', 'Access to main dashboard', 'Dashboard'),
            (2, 'VIEW_PHARMACIES', 'View pharmacy information', 'Pharmacies'),
            (3, 'EDIT_PHARMACIES', 'Edit pharmacy information', 'Pharmacies'),
            (4, 'VIEW_ANALYTICS', 'Access analytics and reports', 'Analytics'),
            (5, 'VIEW_PATIENT_ADHERENCE', 'View patient adherence data', 'Patient Care'),
            (6, 'VIEW_REFILL_PREDICTIONS', 'View refill predictions', 'Patient Care'),
            (7, 'USE_SUPPORT_CHAT', 'Access support chat assistant', 'Support'),
            (8, 'MANAGE_USERS', 'Create, edit, disable users', 'User Management'),
            (9, 'MANAGE_ROLES', 'Create and manage user roles', 'User Management'),
            (10, 'SYSTEM_ADMIN', 'Full system administration access', 'Administration'),
            (11, 'VIEW_REPORTS', 'Access to all reporting features', 'Reports'),
            (12, 'EXPORT_DATA', 'Export data to various formats', 'Data'),
            (13, 'VIEW_BIR_MONITORING', 'Access BIR integration monitoring', 'Integration')
        ) AS p(PermissionID, PermissionName, PermissionDescription, Module)
        WHERE p.PermissionID IN (SELECT 1 + p_partkey % 13 FROM part)""",
    "matrix": """
        SELECT r.RoleID, r.RoleName, p.PermissionID, p.PermissionName
        FROM roles r CROSS JOIN permissions p
        WHERE (r.RoleName = 'Super Admin' AND p.IsActive = 1)
           OR (r.RoleName = 'Pharmacy Manager' AND p.PermissionID IN (1, 2, 3, 4, 5, 6, 7, 11, 12, 13))
           OR (r.RoleName = 'Data Analyst' AND p.PermissionID IN (1, 2, 4, 5, 6, 7, 11, 12))
           OR (r.RoleName = 'Support Staff' AND p.PermissionID IN (1, 2, 7, 13))
           OR (r.RoleName = 'Viewer' AND p.PermissionID IN (1, 2))""",
    "users_roles": """
        SELECT u.Userid, u.Username, u.Email, u.Firstname, u.Lastname, u.Status, u.StatusUDC,
               u.IsSuperAdmin, CAST(u.CreatedDate AS VARCHAR) AS CreatedDate,
               CAST(u.UpdatedDate AS VARCHAR) AS UpdatedDate, r.RoleName, r.RoleDescription
        FROM users u LEFT JOIN roles r ON u.RoleID = r.RoleID""",
    "messages": """
        SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 13
            WHEN 0 THEN 'Info ' || CAST(conv_id AS VARCHAR)
            WHEN 1 THEN 'BIR ' || CAST(conv_id AS VARCHAR)
            WHEN 2 THEN 'error ' || CAST(conv_id AS VARCHAR)
            WHEN 3 THEN 'Show pharmacy ' || CAST(conv_id AS VARCHAR)
            WHEN 4 THEN 'pharmacy status'
            WHEN 5 THEN 'patient medication history'
            WHEN 6 THEN 'dispensing stats'
            WHEN 7 THEN 'recent prescriptions'
            WHEN 8 THEN 'Last sale for store ' || CAST(conv_id AS VARCHAR)
            WHEN 9 THEN 'last dispense'
            WHEN 10 THEN 'How many barcodes in ' || CAST(conv_id AS VARCHAR)
            WHEN 11 THEN 'help me'
            ELSE text END AS message
        FROM conversations""",
    # Intermediates that more than one statement uses.
    "scripts": """
        SELECT PatPharmSysID, OriginalScriptNumber, Drugname, StoreId, TotalRepeats,
               count(*) AS DispensedRepeats, min(DispensedDate) AS FirstDispense,
               max(DispensedDate) AS LastDispense, max(RepeatNo) AS HighestRepeatNo
        FROM dispense
        WHERE TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL AND OriginalScriptNumber IS NOT NULL
        GROUP BY ALL""",
    "last_dispenses": """
        SELECT d.*, c.contactemail, d.DispensedDate + INTERVAL '30 days' AS Due,
               row_number() OVER (PARTITION BY d.StoreId, d.PatPharmSysID, d.Drugname
                   ORDER BY d.DispensedDate DESC, d.ScriptNo DESC, d.DrugVal DESC) AS rn
        FROM dispense d
        JOIN contacts c ON d.PatPharmSysID = c.patientid AND d.StoreId = c.storeid
        WHERE d.TotalRepeats > 1
          AND d.DispensedDate >= TIMESTAMP '2001-07-31 10:30:00' - INTERVAL '44 days'""",
    "due": """
        SELECT * FROM last_dispenses
        WHERE rn = 1 AND RepeatNo < TotalRepeats
          AND Due <= TIMESTAMP '2001-07-31 10:30:00' + INTERVAL '30 days'""",
    "refill_list": """
        SELECT StoreId, PatPharmSysID AS PatientId, Drugname, BrandName, TotalRepeats, RepeatNo,
               TotalRepeats - RepeatNo AS RepeatsRemaining,
               strftime(DispensedDate, '%Y-%m-%d') AS LastDispenseDate,
               strftime(Due, '%Y-%m-%d') AS PredictedRefillDate,
               contactemail AS ContactEmail,
               CASE WHEN Due < TIMESTAMP '2001-07-31 00:00:00' THEN 'Overdue'
                    WHEN CAST(Due AS DATE) = DATE '2001-07-31' THEN 'Due Today'
                    WHEN CAST(Due AS DATE) = DATE '2001-08-01' THEN 'Due Tomorrow'
                    WHEN Due <= TIMESTAMP '2001-08-07 10:30:00' THEN 'Due This Week'
                    WHEN Due <= TIMESTAMP '2001-08-14 10:30:00' THEN 'Due Next Week'
                    ELSE 'Due Later' END AS Urgency,
               CAST(date_diff('day', DATE '2001-07-31', CAST(Due AS DATE)) AS INT) AS DaysUntilDue
        FROM due WHERE Drugname IS NOT NULL""",
    "ranked_pings": """
        SELECT StoreId, ping, row_number() OVER (PARTITION BY StoreId ORDER BY ping DESC) AS rn
        FROM pings WHERE StoreId IS NOT NULL""",
    "last_pings": """
        SELECT StoreId, max(CASE WHEN rn = 1 THEN ping END) AS lastping,
               max(CASE WHEN rn = 2 THEN ping END) AS previousping
        FROM ranked_pings WHERE rn <= 2 GROUP BY StoreId""",
    "latest_errors": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY PharmacyId ORDER BY ErrorDate DESC, ErrorID DESC) AS rn
            FROM errors WHERE ErrorDate >= TIMESTAMP '2024-01-28 00:00:00')
        WHERE rn <= 50""",
    "patient_counts": """
        SELECT StoreId, coalesce(max(registered), max(dispensed)) AS TotalPatients FROM (
            SELECT StoreId, count(DISTINCT PatientId) AS registered, NULL AS dispensed
            FROM wh_patients WHERE StoreId IS NOT NULL GROUP BY StoreId
            UNION ALL
            SELECT CAST(StoreId AS VARCHAR), NULL, count(DISTINCT PatPharmSysID)
            FROM dispense WHERE StoreId IS NOT NULL GROUP BY StoreId)
        GROUP BY StoreId""",
    "tagged": r"""
        SELECT *, CASE
            WHEN message IS NULL OR message = '' THEN 'empty'
            WHEN starts_with(lower(message), 'bir ') AND regexp_matches(message, '(?i)bir\s+\d+') THEN 'heartbeat'
            WHEN starts_with(lower(message), 'info ') AND regexp_matches(message, '(?i)info\s+\d+') THEN 'store_info'
            WHEN lower(message) LIKE '%pharmacy%' AND regexp_matches(message, '\d') THEN 'store_lookup'
            WHEN lower(message) LIKE '%status%' AND lower(message) LIKE '%pharmac%' THEN 'ask_store_status'
            WHEN lower(message) LIKE '%patient%' AND regexp_matches(lower(message), 'medication|history') THEN 'ask_patient'
            WHEN regexp_matches(lower(message), 'dispensing|stats|statistics') THEN 'today_stats'
            WHEN lower(message) LIKE '%recent%' AND regexp_matches(lower(message), 'prescription|script') THEN 'recent_dispenses'
            WHEN regexp_matches(lower(message), 'last|latest') AND regexp_matches(lower(message), 'transaction|sale|dispense')
                THEN CASE WHEN NOT regexp_matches(message, '\d') THEN 'ask_store'
                          WHEN lower(message) LIKE '%sale%' THEN 'last_sale'
                          WHEN lower(message) LIKE '%dispense%' THEN 'last_dispense'
                          ELSE 'no_records' END
            WHEN regexp_matches(lower(message), 'stock|barcode|ean') AND regexp_matches(lower(message), 'count|how many')
                THEN CASE WHEN regexp_matches(message, '\d') THEN 'stock_counts' ELSE 'ask_store' END
            WHEN starts_with(lower(message), 'error ') AND regexp_matches(message, '(?i)error\s+\d+') THEN 'store_errors'
            WHEN regexp_matches(lower(message), 'error|issue|problem')
                 AND (lower(message) LIKE '%store%' OR regexp_matches(message, '\d'))
                THEN CASE WHEN regexp_matches(message, '\d') THEN 'store_errors' ELSE 'ask_store' END
            WHEN regexp_matches(lower(message), 'help|troubleshoot|issue') THEN 'help'
            ELSE 'unknown' END AS Intent
        FROM messages""",
    "tags": r"""
        SELECT conv_id, turn, message, Intent,
               CASE WHEN Intent IN ('heartbeat', 'store_info', 'store_lookup', 'last_sale', 'last_dispense',
                                    'no_records', 'stock_counts', 'store_errors')
                    THEN nullif(regexp_extract(message, '\d+'), '') END AS StoreNumber
        FROM tagged""",
}

STORE_LABEL = (
    "regexp_replace(coalesce(p.CommercialName, 'Store ' || CAST({id} AS VARCHAR)),"
    " 'chemist discount centre', 'CDC', 'gi')"
)

_SECONDS = "'%Y-%m-%d %H:%M:%S'"

_DRUG_TOTALS = """
    count(*) AS totalDispensed,
    round(CAST(sum(CAST(DrugVal AS DECIMAL(18, 4))) AS DOUBLE), 2) AS totalValue,
    round(CAST(sum(CAST(PatientPrice AS DECIMAL(18, 4))) AS DOUBLE) / count(PatientPrice), 6) AS avgPrice"""

_ADHERENCE = """
    count(*) AS TotalScripts,
    count(*) FILTER (WHERE DispensedRepeats = TotalRepeats + 1) AS FullyCompliantScripts,
    count(*) FILTER (WHERE DispensedRepeats > (TotalRepeats + 1) * 0.8) AS HighCompliantScripts,
    count(*) FILTER (WHERE DispensedRepeats < (TotalRepeats + 1) * 0.5) AS LowCompliantScripts,
    count(DISTINCT PatPharmSysID) AS TotalPatients,
    round(avg(CAST(DispensedRepeats AS DOUBLE) / (TotalRepeats + 1) * 100), 6) AS OverallComplianceRate"""

_BY_REPEAT = """
    CASE WHEN RepeatNo > 5 THEN '5+' ELSE CAST(RepeatNo AS VARCHAR) END AS RepeatNo,
    count(*) AS TotalDispenses,
    count(DISTINCT PatPharmSysID) AS UniquePatients,
    CAST(trunc(avg(date_diff('day', DatePrescribed, DispensedDate))) AS INT) AS AvgDaysFromPrescription"""

_DUE_COUNTS = """
    count(*) AS TotalPredictions,
    count(*) FILTER (WHERE Due < TIMESTAMP '2001-07-31 00:00:00') AS Overdue,
    count(*) FILTER (WHERE CAST(Due AS DATE) = DATE '2001-07-31') AS DueToday,
    count(*) FILTER (WHERE Due <= TIMESTAMP '2001-08-07 10:30:00') AS DueThisWeek,
    count(*) FILTER (WHERE Due <= TIMESTAMP '2001-08-30 10:30:00') AS DueInSelectedPeriod,
    count(DISTINCT PatPharmSysID) AS UniquePatients"""

_GAPS = """
    SELECT PatPharmSysID, OriginalScriptNumber, Drugname, StoreId, TotalRepeats,
           DispensedRepeats AS ActualRepeats, HighestRepeatNo,
           TotalRepeats + 1 - DispensedRepeats AS MissedRepeats
    FROM scripts WHERE HighestRepeatNo < TotalRepeats"""

_MINUTES = "CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - h.lastping) / 60) AS BIGINT)"

# column, declared type
_DISPENSE_COLUMNS = (
    ("PatPharmSysID", "string"),
    ("OriginalScriptNumber", "string"),
    ("ScriptNo", "bigint"),
    ("Drugname", "string"),
    ("BrandName", "string"),
    ("DrugSchedule", "string"),
    ("StoreId", "int"),
    ("TotalRepeats", "int"),
    ("RepeatNo", "int"),
    ("DispensedDate", "timestamp_ntz"),
    ("DatePrescribed", "timestamp_ntz"),
    ("DrugVal", "string"),
    ("PatientPrice", "double"),
)

_PROFILE = " UNION ALL ".join(
    f"SELECT {place} AS position, '{name}' AS column_name, '{kind}' AS data_type, 'YES' AS nullable,"
    f" count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count,"
    f" CAST(min({name}) AS VARCHAR) AS min_value, CAST(max({name}) AS VARCHAR) AS max_value FROM dispense"
    for place, (name, kind) in enumerate(_DISPENSE_COLUMNS, 1)
)

_COUNTED = ("dispense", "stores", "patients", "sales", "ean_links", "errors", "users", "messages")

QUERIES = {
    "store_list": """
        SELECT PharmacyID, CommercialName AS StoreName, TimeZoneState AS State,
               CAST(CASE WHEN ExcludeHC = 1 THEN 0 ELSE 1 END AS INT) AS IsActive
        FROM stores""",
    "store_detail": """
        SELECT PharmacyID, CommercialName AS StoreName, TimeZoneState AS State,
               ContactPerson1 AS ContactPerson, CAST(NULL AS VARCHAR) AS ContactNumber,
               CAST(NULL AS VARCHAR) AS PharmacyGroupId, CAST(NULL AS VARCHAR) AS Notes,
               CAST(CASE WHEN ExcludeHC = 1 THEN 0 ELSE 1 END AS INT) AS IsActive,
               CAST(NULL AS VARCHAR) AS UpdatedDate, 1 AS DatabaseIsActive,
               CAST(NULL AS VARCHAR) AS ContactPerson2, CAST(NULL AS VARCHAR) AS BestContactTime
        FROM stores""",
    "store_lookup": """
        SELECT PharmacyID, CommercialName AS StoreName, ContactPerson1,
               CAST(NULL AS VARCHAR) AS ContactNumber, TimeZoneState AS State,
               CASE WHEN ExcludeHC = 0 THEN 'Active' ELSE 'Inactive' END AS Status
        FROM stores""",
    "search_stores": """
        SELECT PharmacyID, CommercialName AS StoreName, TimeZoneState AS State,
               CAST(CASE WHEN ExcludeHC = 1 THEN 0 ELSE 1 END AS INT) AS IsActive
        FROM stores
        WHERE CAST(PharmacyID AS VARCHAR) ILIKE '%chemist%' OR CommercialName ILIKE '%chemist%'
           OR TimeZoneState ILIKE '%chemist%'""",
    "store_filter_options": """
        SELECT DISTINCT d.StoreId AS storeId, p.CommercialName AS storeName
        FROM dispense d LEFT JOIN stores p ON d.StoreId = p.PharmacyID
        WHERE d.StoreId IS NOT NULL""",
    "adherence_stores": f"""
        SELECT d.StoreId AS storeId, {STORE_LABEL.format(id="d.StoreId")} AS storeName,
               count(*) AS recordCount
        FROM dispense d LEFT JOIN stores p ON d.StoreId = p.PharmacyID
        WHERE d.StoreId IS NOT NULL
        GROUP BY d.StoreId, p.CommercialName HAVING count(*) > 100""",
    "refill_stores": f"""
        SELECT c.storeid AS storeId, {STORE_LABEL.format(id="c.storeid")} AS storeName,
               count(DISTINCT c.patientid) AS patientCount
        FROM contacts c LEFT JOIN stores p ON c.storeid = p.PharmacyID
        GROUP BY c.storeid, p.CommercialName""",
    "store_activity": """
        SELECT p.PharmacyID AS StoreId, p.CommercialName AS StoreName, p.TimeZoneState AS State,
               count(DISTINCT d.PatPharmSysID) AS UniquePatients,
               count(DISTINCT d.OriginalScriptNumber) AS UniqueScripts
        FROM stores p LEFT JOIN dispense d ON p.PharmacyID = d.StoreId
        GROUP BY p.PharmacyID, p.CommercialName, p.TimeZoneState""",
    "store_contacts": """
        SELECT p.PharmacyID AS StoreId, p.CommercialName AS StoreName, p.TimeZoneState AS State,
               count(DISTINCT c.patientid) AS ConfiguredPatients
        FROM stores p LEFT JOIN contacts c ON p.PharmacyID = c.storeid
        GROUP BY p.PharmacyID, p.CommercialName, p.TimeZoneState""",
    "patient_count_fallback": "SELECT * FROM patient_counts",
    "store_360": f"""
        SELECT p.PharmacyID AS StoreId, p.CommercialName AS StoreName, p.TimeZoneState AS State,
               p.ContactPerson1 AS ContactPerson, CAST(NULL AS VARCHAR) AS ContactNumber,
               CASE WHEN p.ExcludeHC = 1 THEN 'Inactive' ELSE 'Active' END AS Status,
               CASE WHEN p.BIRExtractionFlag = 1 THEN 'Active' ELSE 'Inactive' END AS BIRStatus,
               strftime(s.last, {_SECONDS}) AS LastSalesDate, coalesce(s.n, 0) AS TotalSales,
               coalesce(k.n, 0) AS StockCount, coalesce(e.u, 0) AS UniqueBarcodes,
               coalesce(e.n, 0) AS TotalLinks, coalesce(c.TotalPatients, 0) AS TotalPatients,
               CASE WHEN p.BIRExtractionFlag = 1 THEN strftime(h.lastping, {_SECONDS}) END AS LastPing,
               CASE WHEN p.BIRExtractionFlag = 1 THEN strftime(h.previousping, {_SECONDS}) END AS PreviousPing
        FROM stores p
        LEFT JOIN (SELECT StoreId, max(SalesDate) AS last, count(*) AS n FROM sales GROUP BY 1) s
               ON s.StoreId = CAST(p.PharmacyID AS VARCHAR)
        LEFT JOIN (SELECT StoreId, count(*) AS n FROM stock GROUP BY 1) k
               ON k.StoreId = CAST(p.PharmacyID AS VARCHAR)
        LEFT JOIN (SELECT StoreId, count(DISTINCT EAN) AS u, count(*) AS n FROM ean_links GROUP BY 1) e
               ON e.StoreId = CAST(p.PharmacyID AS VARCHAR)
        LEFT JOIN patient_counts c ON c.StoreId = CAST(p.PharmacyID AS VARCHAR)
        LEFT JOIN last_pings h ON h.StoreId = p.PharmacyID""",
    "dispense_filter": """
        SELECT * REPLACE (CAST(DispensedDate AS VARCHAR) AS DispensedDate,
                          CAST(DatePrescribed AS VARCHAR) AS DatePrescribed)
        FROM dispense d
        WHERE d.DispensedDate >= TIMESTAMP '2001-07-31 10:30:00' - INTERVAL '365 days'
          AND DrugSchedule = 'ECONOMY' AND Drugname ILIKE '%ring%' AND TotalRepeats >= 3""",
    "dispense_summary": """
        SELECT count(*) AS totalDispenses,
               round(coalesce(CAST(sum(CAST(DrugVal AS DECIMAL(18, 4))) AS DOUBLE), 0), 2) AS totalValue,
               count(DISTINCT StoreId) AS totalStores
        FROM dispense""",
    "dispense_summary_by_store": """
        SELECT StoreId, count(*) AS totalDispenses,
               round(coalesce(CAST(sum(CAST(DrugVal AS DECIMAL(18, 4))) AS DOUBLE), 0), 2) AS totalValue,
               count(DISTINCT StoreId) AS totalStores
        FROM dispense
        WHERE DispensedDate >= TIMESTAMP '2001-07-31 10:30:00' - INTERVAL '365 days'
        GROUP BY StoreId""",
    "patient_total": "SELECT count(DISTINCT dispenseid) AS totalPatients FROM patients",
    "daily_trend": """
        SELECT strftime(DispensedDate, '%Y-%m-%d') AS date, count(*) AS count
        FROM dispense
        WHERE DispensedDate >= TIMESTAMP '2001-07-31 10:30:00' - INTERVAL '30 days'
        GROUP BY 1""",
    "daily_trend_by_store": """
        SELECT StoreId, strftime(DispensedDate, '%Y-%m-%d') AS date, count(*) AS count
        FROM dispense
        WHERE DispensedDate >= TIMESTAMP '2001-07-31 10:30:00' - INTERVAL '30 days'
        GROUP BY 1, 2""",
    "top_drugs": f"""
        SELECT *, CAST(row_number() OVER (ORDER BY totalDispensed DESC, drugName, brandName) AS INT) AS rank
        FROM (SELECT Drugname AS drugName, BrandName AS brandName, {_DRUG_TOTALS}
              FROM dispense WHERE Drugname IS NOT NULL GROUP BY Drugname, BrandName)
        QUALIFY rank <= 10""",
    "top_drugs_by_store": f"""
        SELECT *, CAST(row_number() OVER (PARTITION BY StoreId
                     ORDER BY totalDispensed DESC, drugName, brandName) AS INT) AS rank
        FROM (SELECT StoreId, Drugname AS drugName, BrandName AS brandName, {_DRUG_TOTALS}
              FROM dispense WHERE Drugname IS NOT NULL GROUP BY StoreId, Drugname, BrandName)
        QUALIFY rank <= 3""",
    "schedule_mix": """
        SELECT coalesce(DrugSchedule, 'Unclassified') AS category, count(*) AS count
        FROM dispense GROUP BY DrugSchedule""",
    "schedule_mix_by_store": """
        SELECT StoreId, coalesce(DrugSchedule, 'Unclassified') AS category, count(*) AS count
        FROM dispense GROUP BY StoreId, DrugSchedule""",
    "store_ranking": """
        SELECT StoreId AS storeId, count(*) AS count,
               round(CAST(sum(CAST(DrugVal AS DECIMAL(18, 4))) AS DOUBLE), 2) AS totalValue
        FROM dispense
        WHERE StoreId IS NOT NULL
          AND DispensedDate >= TIMESTAMP '2001-07-31 10:30:00' - INTERVAL '90 days'
        GROUP BY StoreId ORDER BY count DESC, storeId LIMIT 10""",
    "gender_mix": """
        SELECT CASE WHEN lower(gender) LIKE '%female%' THEN 'female' ELSE 'male' END AS gender,
               count(*) AS count
        FROM patients WHERE lower(gender) LIKE '%male%' GROUP BY 1""",
    "schedule_options": """
        SELECT DISTINCT DrugSchedule FROM dispense WHERE DrugSchedule IS NOT NULL AND DrugSchedule <> ''""",
    "today_stats": """
        SELECT count(DISTINCT PatPharmSysID) AS UniquePatients, count(*) AS TotalDispenses,
               count(DISTINCT StoreId) AS ActiveStores
        FROM dispense WHERE CAST(DispensedDate AS DATE) = DATE '2001-07-31'""",
    "recent_dispenses": f"""
        SELECT ScriptNo, PatPharmSysID, Drugname, StoreId, strftime(DispensedDate, {_SECONDS}) AS DispensedDate
        FROM (SELECT * FROM dispense ORDER BY DispensedDate DESC, ScriptNo DESC, DrugVal DESC LIMIT 10)""",
    "patient_scripts": """
        SELECT PatPharmSysID, OriginalScriptNumber, Drugname, StoreId, TotalRepeats, DispensedRepeats,
               CAST(FirstDispense AS VARCHAR) AS FirstDispense,
               CAST(LastDispense AS VARCHAR) AS LastDispense,
               CAST(date_diff('day', FirstDispense, LastDispense) AS INT) AS DaysBetween
        FROM scripts""",
    "adherence_summary": f"SELECT {_ADHERENCE} FROM scripts",
    "adherence_summary_by_store": f"SELECT StoreId, {_ADHERENCE} FROM scripts GROUP BY StoreId",
    "medication_compliance": """
        SELECT Drugname, count(*) AS TotalScripts, count(DISTINCT PatPharmSysID) AS TotalPatients,
               round(avg(rate), 6) AS AvgComplianceRate,
               count(*) FILTER (WHERE rate >= 100) AS FullyCompliant,
               count(*) FILTER (WHERE rate < 50) AS LowCompliance
        FROM (SELECT Drugname, PatPharmSysID, OriginalScriptNumber, TotalRepeats,
                     CAST(count(*) AS DOUBLE) / (TotalRepeats + 1) * 100 AS rate
              FROM dispense
              WHERE TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL AND OriginalScriptNumber IS NOT NULL
              GROUP BY Drugname, PatPharmSysID, OriginalScriptNumber, TotalRepeats)
        GROUP BY Drugname ORDER BY TotalScripts DESC, Drugname NULLS FIRST LIMIT 10""",
    "medication_compliance_by_store": """
        SELECT StoreId, Drugname, count(*) AS TotalScripts, count(DISTINCT PatPharmSysID) AS TotalPatients,
               round(avg(100.0::DOUBLE * DispensedRepeats / (TotalRepeats + 1)), 6) AS AvgComplianceRate,
               count(*) FILTER (WHERE DispensedRepeats >= TotalRepeats + 1) AS FullyCompliant,
               count(*) FILTER (WHERE 2 * DispensedRepeats < TotalRepeats + 1) AS LowCompliance
        FROM scripts GROUP BY StoreId, Drugname
        QUALIFY row_number() OVER (PARTITION BY StoreId
            ORDER BY count(*) DESC, Drugname NULLS FIRST) <= 10""",
    "compliance_by_repeat": f"""
        SELECT {_BY_REPEAT} FROM dispense d
        WHERE d.RepeatNo IS NOT NULL AND TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL
        GROUP BY CASE WHEN d.RepeatNo > 5 THEN '5+' ELSE CAST(d.RepeatNo AS VARCHAR) END""",
    "compliance_by_repeat_by_store": f"""
        SELECT StoreId, {_BY_REPEAT} FROM dispense d
        WHERE d.RepeatNo IS NOT NULL AND TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL
        GROUP BY StoreId, CASE WHEN d.RepeatNo > 5 THEN '5+' ELSE CAST(d.RepeatNo AS VARCHAR) END""",
    "medication_gaps": f"""
        {_GAPS} ORDER BY MissedRepeats DESC, TotalRepeats DESC, PatPharmSysID, OriginalScriptNumber,
                         Drugname NULLS FIRST, StoreId LIMIT 20""",
    "medication_gaps_all": _GAPS,
    "medication_gaps_by_store": f"""
        {_GAPS} QUALIFY row_number() OVER (PARTITION BY StoreId
            ORDER BY TotalRepeats + 1 - DispensedRepeats DESC, TotalRepeats DESC, PatPharmSysID,
                     OriginalScriptNumber, Drugname NULLS FIRST) <= 20""",
    "chronic_medications_by_store": """
        SELECT StoreId, Drugname, TotalPatients, TotalDispenses, round(AvgTotalRepeats, 6) AS AvgTotalRepeats,
               LongTermScripts, round(Rate, 6) AS ChronicMedicationRate
        FROM (SELECT StoreId, Drugname, count(DISTINCT PatPharmSysID) AS TotalPatients,
                     count(*) AS TotalDispenses, avg(CAST(TotalRepeats AS DOUBLE)) AS AvgTotalRepeats,
                     count(*) FILTER (WHERE TotalRepeats >= 5) AS LongTermScripts,
                     CAST(LongTermScripts AS DOUBLE) / count(*) * 100 AS Rate
              FROM dispense WHERE TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL
              GROUP BY StoreId, Drugname)
        WHERE TotalPatients >= 10
        QUALIFY row_number() OVER (PARTITION BY StoreId
            ORDER BY Rate DESC, TotalPatients DESC, Drugname NULLS FIRST) <= 15""",
    "chronic_medications": """
        SELECT Drugname, count(DISTINCT PatPharmSysID) AS TotalPatients, count(*) AS TotalDispenses,
               round(avg(CAST(TotalRepeats AS DOUBLE)), 6) AS AvgTotalRepeats,
               count(*) FILTER (WHERE TotalRepeats >= 5) AS LongTermScripts,
               round(CAST(count(*) FILTER (WHERE TotalRepeats >= 5) AS DOUBLE) / count(*) * 100, 6)
                   AS ChronicMedicationRate
        FROM dispense WHERE TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL
        GROUP BY Drugname HAVING count(DISTINCT PatPharmSysID) >= 10
        ORDER BY CAST(count(*) FILTER (WHERE TotalRepeats >= 5) AS DOUBLE) / count(*) DESC,
                 TotalPatients DESC, Drugname NULLS FIRST LIMIT 15""",
    "repeat_sequence": """
        SELECT StoreId, PatPharmSysID, OriginalScriptNumber, RepeatNo,
               CAST(DispensedDate AS VARCHAR) AS DispensedDate, Drugname, TotalRepeats,
               row_number() OVER (PARTITION BY StoreId, PatPharmSysID, OriginalScriptNumber
                   ORDER BY d.RepeatNo NULLS FIRST, d.DispensedDate NULLS FIRST, Drugname NULLS FIRST,
                            TotalRepeats) AS ExpectedSequence
        FROM dispense d
        WHERE TotalRepeats >= 2 AND PatPharmSysID IS NOT NULL AND OriginalScriptNumber IS NOT NULL""",
    "build_patient_contacts": "SELECT * FROM contacts",
    "dispense_with_contact": """
        SELECT d.StoreId, d.PatPharmSysID, d.ScriptNo, CAST(d.DispensedDate AS VARCHAR) AS DispensedDate,
               c.contactemail AS ContactEmail
        FROM dispense d JOIN contacts c ON d.PatPharmSysID = c.patientid AND d.StoreId = c.storeid""",
    "latest_dispense": """
        SELECT StoreId, PatPharmSysID, Drugname, CAST(DispensedDate AS VARCHAR) AS DispensedDate, ScriptNo, RepeatNo
        FROM (SELECT *, row_number() OVER (PARTITION BY StoreId, PatPharmSysID, Drugname
                  ORDER BY DispensedDate DESC, ScriptNo DESC, DrugVal DESC) AS rn FROM dispense)
        WHERE rn = 1""",
    "refill_predictions": "SELECT * FROM refill_list",
    "refill_summary": f"SELECT {_DUE_COUNTS} FROM due",
    "refill_summary_by_store": f"SELECT StoreId, {_DUE_COUNTS} FROM due GROUP BY StoreId",
    "export_refills_csv": """
        SELECT PatientId AS "Patient ID", Drugname AS "Medication", BrandName AS "Brand",
               LastDispenseDate AS "Last Dispense", PredictedRefillDate AS "Predicted Refill",
               CAST(nullif(DaysUntilDue, 0) AS VARCHAR) AS "Days Until Due",
               CAST(nullif(RepeatsRemaining, 0) AS VARCHAR) AS "Repeats Remaining",
               CAST(nullif(TotalRepeats, 0) AS VARCHAR) AS "Total Repeats",
               ContactEmail AS "Contact Email", Urgency AS "Urgency"
        FROM refill_list""",
    "last_sale": f"""
        SELECT StoreId, strftime(max(SalesDate), {_SECONDS}) AS LastSalesDate, count(*) AS TotalRecords
        FROM sales GROUP BY StoreId""",
    "last_dispense": f"""
        SELECT StoreId, strftime(DispensedDate, {_SECONDS}) AS LastDispenseDate, ScriptNo, Drugname,
               PatPharmSysID, TotalRecords
        FROM (SELECT *, count(*) OVER (PARTITION BY StoreId) AS TotalRecords,
                     row_number() OVER (PARTITION BY StoreId
                         ORDER BY DispensedDate DESC, ScriptNo DESC, DrugVal DESC) AS rn FROM dispense)
        WHERE rn = 1""",
    "stock_counts": "SELECT StoreId, count(*) AS StockCount FROM stock GROUP BY StoreId",
    "barcode_counts": """
        SELECT StoreId, count(DISTINCT EAN) AS UniqueBarcodes, count(*) AS TotalLinks
        FROM ean_links GROUP BY StoreId""",
    "heartbeat_pings": """
        SELECT StoreId, CAST(lastping AS VARCHAR) AS lastping, CAST(previousping AS VARCHAR) AS previousping
        FROM last_pings""",
    "heartbeat_status": f"""
        SELECT p.PharmacyID AS StoreId, p.CommercialName AS StoreName,
               CASE WHEN p.BIRExtractionFlag IS DISTINCT FROM 1 THEN 'Inactive'
                    WHEN h.StoreId IS NULL THEN 'NoData'
                    WHEN h.lastping IS NULL THEN 'Unknown'
                    WHEN {_MINUTES} <= 30 THEN 'Healthy'
                    WHEN {_MINUTES} <= 60 THEN 'Warning' ELSE 'Critical' END AS Status,
               CASE WHEN p.BIRExtractionFlag = 1 THEN strftime(h.lastping, {_SECONDS}) END AS LastPing,
               CASE WHEN p.BIRExtractionFlag = 1 THEN strftime(h.previousping, {_SECONDS}) END AS PreviousPing,
               CASE WHEN p.BIRExtractionFlag = 1 THEN CAST({_MINUTES} AS VARCHAR) END AS MinutesSinceLast
        FROM stores p LEFT JOIN last_pings h ON h.StoreId = p.PharmacyID""",
    "recent_errors": f"""
        SELECT PharmacyId, ErrorID, ErrorIndicator, ErrorTypeUDC, ErrorSource, ErrorMessage,
               CASE WHEN ErrorMessage IS NULL OR ErrorMessage = '' THEN 'N/A'
                    WHEN length(ErrorMessage) > 60 THEN left(ErrorMessage, 60) || '...'
                    ELSE ErrorMessage END AS MessagePreview,
               CAST(NULL AS VARCHAR) AS StepUDC, TableName, strftime(ErrorDate, {_SECONDS}) AS ErrorDate
        FROM latest_errors""",
    "error_type_summary": """
        SELECT PharmacyId, coalesce(ErrorTypeUDC, 'Unknown') AS ErrorType, count(*) AS ErrorCount
        FROM latest_errors GROUP BY 1, 2""",
    "error_type_summary_all": """
        SELECT PharmacyId, coalesce(ErrorTypeUDC, 'Unknown') AS ErrorType, count(*) AS ErrorCount
        FROM errors WHERE ErrorDate >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1, 2""",
    "error_source_summary": """
        SELECT PharmacyId, coalesce(ErrorSource, 'Unknown') AS ErrorSource, count(*) AS ErrorCount
        FROM latest_errors e GROUP BY PharmacyId, e.ErrorSource""",
    "flag_ignored_errors": """
        SELECT ErrorID, ErrorMessage, CAST(IgnoreReason IS NOT NULL AS INT) AS IsIgnored, IgnoreReason
        FROM (SELECT *, CASE
            WHEN lower(ErrorMessage) LIKE '%sqlite error no such table: department\\_pos%' ESCAPE '\\'
                THEN 'Department_POS table is not used in current implementation'
            WHEN lower(ErrorMessage) LIKE '%no such table: department\\_pos%' ESCAPE '\\'
                THEN 'Alternative pattern for Department_POS table error'
            WHEN lower(ErrorMessage) LIKE '%bulk copy failed%'
                THEN 'Alternative pattern for Bulk Copy Failed'
            WHEN regexp_matches(ErrorMessage, '(?i)^.*no such table: Department_.*$')
                THEN 'Ignore all Department-related table errors' END AS IgnoreReason
            FROM errors)""",
    "dashboard_counts": """
        SELECT (SELECT count(*) FROM stores) AS pharmacies,
               (SELECT count(*) FROM users WHERE StatusUDC = 'SUS10') AS users""",
    "active_roles": "SELECT RoleID, RoleName, RoleDescription, IsActive FROM roles WHERE IsActive = 1",
    "role_permission_matrix": "SELECT * FROM matrix",
    "user_permissions": """
        SELECT DISTINCT u.Username, p.PermissionName, p.PermissionDescription, p.Module
        FROM users u
        JOIN roles r ON u.RoleID = r.RoleID
        JOIN matrix m ON r.RoleID = m.RoleID
        JOIN permissions p ON m.PermissionID = p.PermissionID
        WHERE u.StatusUDC = 'SUS10' AND r.IsActive = 1 AND p.IsActive = 1""",
    "users_with_roles": "SELECT * FROM users_roles",
    "search_users": """
        SELECT * FROM users_roles
        WHERE Firstname ILIKE '%analyst%' OR Lastname ILIKE '%analyst%' OR Username ILIKE '%analyst%'
           OR Email ILIKE '%analyst%' OR RoleName ILIKE '%analyst%'""",
    "lookup_by_keys": """
        SELECT Userid, Username FROM users
        WHERE Userid IN (SELECT CAST(PatPharmSysID AS BIGINT) FROM dispense WHERE PatPharmSysID IS NOT NULL)""",
    "not_exists_insert": """
        SELECT Userid, Username FROM users u
        WHERE NOT EXISTS (SELECT 1 FROM dispense d WHERE CAST(d.PatPharmSysID AS BIGINT) = u.Userid)""",
    "seeded_table": """
        SELECT DISTINCT CAST(PatPharmSysID AS BIGINT) AS Userid, CAST(NULL AS VARCHAR) AS Username
        FROM dispense WHERE PatPharmSysID IS NOT NULL
        UNION ALL
        SELECT Userid, Username FROM users u
        WHERE NOT EXISTS (SELECT 1 FROM dispense d WHERE CAST(d.PatPharmSysID AS BIGINT) = u.Userid)""",
    "dense_patient_contacts": """
        SELECT row_number() OVER (ORDER BY patientid, storeid) AS id, patientid, storeid, contactemail
        FROM contacts""",
    "patient_count_of_sources": """
        SELECT CAST(StoreId AS VARCHAR) AS StoreId, count(DISTINCT PatPharmSysID) AS TotalPatients,
               'dispenses' AS Source, 'patients' AS Failed
        FROM dispense WHERE StoreId IS NOT NULL GROUP BY StoreId""",
    "warehouse_last_dispense": f"""
        SELECT CAST(StoreId AS VARCHAR) AS StoreId, strftime(DispensedDate, {_SECONDS}) AS LastDispenseDate,
               ScriptNo, Drugname, PatPharmSysID, TotalRecords
        FROM (SELECT *, count(*) OVER (PARTITION BY StoreId) AS TotalRecords,
                     row_number() OVER (PARTITION BY StoreId
                         ORDER BY DispensedDate DESC, ScriptNo DESC, Drugname DESC) AS rn FROM dispense)
        WHERE rn = 1""",
    "page_rows": "SELECT * FROM users_roles ORDER BY CreatedDate DESC, Userid LIMIT 20 OFFSET 20",
    "page_count": """
        SELECT count(*) AS total_rows, CAST(greatest(ceil(count(*) / 20.0), 1) AS BIGINT) AS total_pages
        FROM users""",
    "message_tags": "SELECT * FROM tags",
    "message_intents": """
        SELECT Intent, count(*) AS Messages, count(StoreNumber) AS WithStore FROM tags GROUP BY Intent""",
    "column_profile": _PROFILE,
    "sample_rows": """
        SELECT * REPLACE (CAST(DispensedDate AS VARCHAR) AS DispensedDate,
                          CAST(DatePrescribed AS VARCHAR) AS DatePrescribed)
        FROM (SELECT * FROM dispense ORDER BY DispensedDate, ScriptNo, DrugVal LIMIT 3)""",
    "date_coverage": """
        SELECT CAST(min(DispensedDate) AS VARCHAR) AS EarliestDate,
               CAST(max(DispensedDate) AS VARCHAR) AS LatestDate,
               count(DISTINCT DispensedDate) AS UniqueDays
        FROM dispense""",
    "dispenses_per_store": """
        SELECT StoreId, count(*) AS TotalDispenses FROM dispense WHERE StoreId IS NOT NULL
        GROUP BY StoreId ORDER BY TotalDispenses DESC, StoreId LIMIT 5""",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS total_rows FROM {name}" for name in _COUNTED
    ),
    "table_profile": """
        SELECT 'size' AS section, 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM dispense
        UNION ALL SELECT 'coverage', 'EarliestDate', CAST(min(DispensedDate) AS VARCHAR) FROM dispense
        UNION ALL SELECT 'coverage', 'LatestDate', CAST(max(DispensedDate) AS VARCHAR) FROM dispense
        UNION ALL SELECT 'coverage', 'UniqueDays', CAST(count(DISTINCT DispensedDate) AS VARCHAR) FROM dispense
        UNION ALL
        SELECT 'keys', CAST(place AS VARCHAR) || ': ' || CAST(StoreId AS VARCHAR), CAST(n AS VARCHAR)
        FROM (SELECT StoreId, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, StoreId) AS place
              FROM dispense GROUP BY StoreId)
        WHERE place <= 5""",
    "run_sql": """
        SELECT StoreId, count(*) AS TotalSales FROM sales
        WHERE SalesDate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY StoreId""",
}


def _needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    """The CTEs a statement refers to, each after the ones it uses itself."""
    for name in TABLES:
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(TABLES[name], found)
            found[name] = None
    return found


def with_tables(sql: str) -> str:
    """A statement with the CTEs it needs in front."""
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in _needed(sql, {}))
    return f"WITH {ctes}\n{sql}"


def all_sql() -> dict[str, str]:
    return {key: with_tables(sql) for key, sql in QUERIES.items()}
