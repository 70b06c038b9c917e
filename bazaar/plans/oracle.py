"""Independent SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the sales table from the driver's star-schema views
with the same expressions as ``bazaar.sources.tables.sales_view`` and then
computes the report the textbook way.  Exact rounding is spelled out on
HUGEINT so that both engines round the exact quotient once, half away from zero.
"""

from __future__ import annotations

SALES_CTE = """sales_data AS (
  SELECT
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS Order_ID,
    CASE WHEN l.l_orderkey % 41 <> 0 THEN CAST(o.o_orderdate AS DATE) END AS Order_Date,
    CAST(o.o_custkey AS VARCHAR) AS Customer_ID,
    c.c_name AS Customer_Name,
    CASE WHEN o.o_custkey % 61 = 0 THEN -1 WHEN o.o_custkey % 67 = 0 THEN 12
         WHEN o.o_custkey % 23 <> 0 THEN CAST(16 + o.o_custkey % 60 AS INTEGER) END AS Age,
    CASE WHEN o.o_custkey % 59 <> 0 THEN CASE WHEN o.o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END END AS Gender,
    CASE WHEN l.l_orderkey % 43 <> 0 THEN n.n_name END AS City,
    CASE WHEN l.l_partkey % 53 <> 0 THEN p.p_name END AS Product,
    CASE WHEN l.l_partkey % 47 <> 0 THEN CASE WHEN p.p_type = 'ECONOMY' THEN 'Electronics' ELSE p.p_type END END AS Category,
    CASE WHEN NOT (l.l_linenumber = 6 AND l.l_orderkey % 31 = 0) THEN CAST(l.l_quantity AS INTEGER) END AS Quantity,
    CASE WHEN l.l_partkey % 71 <> 0 THEN CAST(p.p_retailprice AS DECIMAL(12,2)) END AS Unit_Price,
    CASE WHEN (l.l_linenumber = 7 AND l.l_orderkey % 29 = 0) OR coalesce(n.n_nationkey = 7, false) THEN NULL
         ELSE CAST(l.l_extendedprice AS DECIMAL(14,2)) END AS Total_Sales
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""


def quotient(num: str, den: str, scale: int = 2, num_scale: int = 2, den_scale: int = 0, factor: int = 1,
             half_even: bool = False) -> str:
    """SQL for the exact integer ``round(factor * num / den * 10^scale)`` (HUGEINT)."""
    top = f"(CAST(({num}) * {10 ** num_scale} AS HUGEINT) * {factor * 10 ** (scale + den_scale)})"
    bottom = f"(CAST(({den}) * {10 ** den_scale} AS HUGEINT) * {10 ** num_scale})"
    a, b = f"abs({top})", f"abs({bottom})"
    if half_even:
        q = f"({a} // {b})"
        r2 = f"(({a} - {q} * {b}) * 2)"
        mag = f"({q} + CASE WHEN {r2} > {b} OR ({r2} = {b} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    else:
        mag = f"((2 * {a} + {b}) // (2 * {b}))"
    return f"(CASE WHEN {bottom} = 0 THEN NULL WHEN ({top} < 0) <> ({bottom} < 0) THEN -{mag} ELSE {mag} END)"


def ratio(num: str, den: str, scale: int = 2, num_scale: int = 2, den_scale: int = 0, factor: int = 1,
          half_even: bool = False) -> str:
    """SQL for exact ``round(factor * num / den, scale)`` as DOUBLE."""
    return f"(CAST({quotient(num, den, scale, num_scale, den_scale, factor, half_even)} AS DOUBLE) / {10 ** scale})"


def grouped(q: str, decimals: int) -> str:
    """Text of the integer ``q`` units of ``10^-decimals`` with thousands separators."""
    if decimals == 0:
        return f"format('{{:,}}', CAST({q} AS BIGINT))"
    return f"format('{{:,.{decimals}f}}', CAST({q} AS DOUBLE) / {10 ** decimals})"


def plain(q: str, decimals: int) -> str:
    if decimals == 0:
        return f"CAST(CAST({q} AS BIGINT) AS VARCHAR)"
    return f"format('{{:.{decimals}f}}', CAST({q} AS DOUBLE) / {10 ** decimals})"


def signed(text: str, q: str, negative: str) -> str:
    """Python keeps the sign of a negative value that rounds to zero."""
    return f"(CASE WHEN ({negative}) AND ({q}) = 0 THEN '-' ELSE '' END || {text})"


def _neg(num: str, den: str | None = None) -> str:
    return f"(({num}) < 0)" if den is None else f"((({num}) < 0) <> (({den}) < 0) AND ({num}) <> 0)"


def number(amount: str, decimals: int = 0) -> str:
    q = quotient(amount, '1', decimals, 2, 0, 1, True)
    return signed(grouped(q, decimals), q, _neg(amount))


def rupees(amount: str, decimals: int = 0) -> str:
    q = quotient(amount, '1', decimals, 2, 0, 1, True)
    return f"('Rs.' || {signed(grouped(q, decimals), q, _neg(amount))})"


def rupees_of_ratio(num: str, den: str, decimals: int = 0) -> str:
    q = quotient(num, den, decimals, 2, 0, 1, True)
    return f"('Rs.' || {signed(grouped(q, decimals), q, _neg(num, den))})"


def millions(amount: str, decimals: int = 1, suffix: str = "M") -> str:
    q = quotient(amount, '1000000', decimals, 2, 0, 1, True)
    return f"('Rs.' || {signed(plain(q, decimals), q, _neg(amount))} || '{suffix}')"


def percent(num: str, den: str, num_scale: int = 2, den_scale: int = 2) -> str:
    q = quotient(num, den, 1, num_scale, den_scale, 100, True)
    return f"({signed(plain(q, 1), q, _neg(num, den))} || '%')"


def with_sales(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {SALES_CTE}{extra}\n{body}"


REV = "CAST(SUM(Total_Sales) AS DOUBLE)"
AOV = ratio("SUM(Total_Sales)", "COUNT(Total_Sales)")

SQL: dict[str, str] = {}

SQL["total_revenue"] = with_sales(f"""
SELECT {REV} AS Total_Revenue_INR, COUNT(*) AS Total_Orders FROM sales_data""")

SQL["average_order_value"] = with_sales(f"""
SELECT {AOV} AS Average_Order_Value_INR FROM sales_data""")

SQL["top_products"] = with_sales(f"""
SELECT Product, {REV} AS Total_Revenue_INR, CAST(SUM(Quantity) AS BIGINT) AS Total_Units_Sold,
       COUNT(*) AS Total_Orders
FROM sales_data GROUP BY Product
ORDER BY SUM(Total_Sales) DESC NULLS LAST, Product ASC NULLS FIRST
LIMIT 5""")

SQL["revenue_by_category"] = with_sales(f"""
SELECT Category, {REV} AS Total_Revenue_INR, {AOV} AS Avg_Order_Value_INR, COUNT(*) AS Total_Orders,
       {ratio("SUM(Total_Sales)", "(SELECT SUM(Total_Sales) FROM sales_data)", den_scale=2, factor=100)}
         AS Revenue_Share_Pct
FROM sales_data GROUP BY Category""")

SQL["revenue_by_city"] = with_sales(f"""
SELECT City, {REV} AS Total_Revenue_INR, {AOV} AS Avg_Order_Value_INR, COUNT(*) AS Total_Orders,
       COUNT(DISTINCT Customer_ID) AS Unique_Customers
FROM sales_data GROUP BY City""")

SQL["revenue_by_city_ci"] = with_sales(f"""
SELECT upper(City) AS City, {REV} AS Total_Revenue_INR, {AOV} AS Avg_Order_Value_INR, COUNT(*) AS Total_Orders,
       COUNT(DISTINCT Customer_ID) AS Unique_Customers
FROM (SELECT * REPLACE (CASE WHEN Quantity % 2 = 0 THEN lower(City) ELSE City END AS City) FROM sales_data)
GROUP BY upper(City)""")

SQL["monthly_revenue"] = with_sales(f"""
SELECT CAST(year(Order_Date) AS INTEGER) AS Year, CAST(month(Order_Date) AS INTEGER) AS Month_Num,
       strftime(Order_Date, '%b %Y') AS Month_Label, {REV} AS Monthly_Revenue_INR, COUNT(*) AS Orders_Count
FROM sales_data WHERE Order_Date IS NOT NULL
GROUP BY 1, 2, 3""")

SQL["product_quantity"] = with_sales(f"""
SELECT Product, CAST(SUM(Quantity) AS BIGINT) AS Total_Quantity_Sold, {REV} AS Total_Revenue_INR,
       {ratio("SUM(Unit_Price)", "COUNT(Unit_Price)")} AS Avg_Unit_Price_INR
FROM sales_data GROUP BY Product""")

SQL["revenue_by_gender"] = with_sales(f"""
SELECT Gender, COUNT(*) AS Total_Orders, {REV} AS Total_Revenue_INR, {AOV} AS Avg_Order_Value_INR
FROM sales_data GROUP BY Gender""")

SQL["age_band_revenue"] = with_sales(f"""
SELECT CASE WHEN Age < 20 THEN 'Under 20'
            WHEN Age BETWEEN 20 AND 29 THEN '20 – 29'
            WHEN Age BETWEEN 30 AND 39 THEN '30 – 39'
            WHEN Age BETWEEN 40 AND 49 THEN '40 – 49'
            WHEN Age BETWEEN 50 AND 59 THEN '50 – 59'
            ELSE '60+' END AS Age_Group,
       COUNT(*) AS Total_Orders, {REV} AS Total_Revenue_INR, {AOV} AS Avg_Order_Value_INR
FROM sales_data WHERE Age IS NOT NULL
GROUP BY 1""")

SQL["city_category_matrix"] = with_sales(f"""
SELECT City, Category, {REV} AS Revenue_INR, COUNT(*) AS Orders
FROM sales_data GROUP BY City, Category""")

# ---------------------------------------------------------------------------
# EDA half: NULL keys dropped, empty sums are 0, Python's ties-to-even rounding.
# ---------------------------------------------------------------------------

HE = dict(half_even=True)
ZREV = "COALESCE(SUM(Total_Sales), 0)"


def dim_cte(dim: str) -> str:
    return (f"g AS (SELECT {dim}, {ZREV} AS rev, COUNT(Total_Sales) AS n, COUNT(*) AS rows_, "
            f"COALESCE(SUM(Quantity), 0) AS units, COUNT(Order_ID) AS ids "
            f"FROM sales_data WHERE {dim} IS NOT NULL GROUP BY {dim})")


ALL_COLUMNS = ("Order_ID, Order_Date, Customer_ID, Customer_Name, Age, Gender, City, Product, Category, "
               "Quantity, Unit_Price, Total_Sales")


def _sorted_list(dim: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {dim}) FILTER (WHERE {dim} IS NOT NULL)), ', ')"


SQL["dataset_summary"] = with_sales(f"""
SELECT COUNT(*) AS Rows, 12 AS Columns, '{ALL_COLUMNS}' AS Column_List,
       MIN(Order_Date) AS Date_Min, MAX(Order_Date) AS Date_Max,
       COUNT(DISTINCT City) AS Cities, {_sorted_list("City")} AS City_List,
       COUNT(DISTINCT Category) AS Categories, {_sorted_list("Category")} AS Category_List,
       COUNT(DISTINCT Product) AS Products, {_sorted_list("Product")} AS Product_List
FROM sales_data""")

SQL["dimension_values"] = with_sales("""
SELECT Dimension, row_number() OVER (PARTITION BY Dimension ORDER BY Value) AS Position, Value
FROM (SELECT DISTINCT 'City' AS Dimension, City AS Value FROM sales_data
      UNION ALL SELECT DISTINCT 'Category', Category FROM sales_data
      UNION ALL SELECT DISTINCT 'Product', Product FROM sales_data)
WHERE Value IS NOT NULL""")

_cols = [c.strip() for c in ALL_COLUMNS.split(",")]
_cells = "\n  UNION ALL ".join(
    f"SELECT {i} AS Position, '{c}' AS \"Column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS Missing_Count, "
    f"COUNT(*) AS n FROM sales_data" for i, c in enumerate(_cols))
SQL["missing_values"] = with_sales(f"""
SELECT Position, "Column", Missing_Count,
       {ratio("Missing_Count", "n", scale=2, num_scale=0, factor=100, **HE)} AS Missing_Pct
FROM cells WHERE Missing_Count > 0""", f"cells AS (\n  {_cells})")


def _describe(col: str, scale: int) -> str:
    x = f"CAST({col} AS DOUBLE)"
    q = lambda p: f"round(quantile_cont({x}, {p}), 6)"
    return (f"SELECT '{col}' AS \"Column\", COUNT({col}) AS Count, "
            f"{ratio(f'SUM({col})', f'COUNT({col})', scale=6, num_scale=scale, **HE)} AS Mean, "
            f"round(stddev_samp({x}), 6) AS Std, CAST(MIN({col}) AS DOUBLE) AS Min, "
            f"{q(0.25)} AS P25, {q(0.5)} AS P50, {q(0.75)} AS P75, CAST(MAX({col}) AS DOUBLE) AS Max "
            f"FROM sales_data")


SQL["describe_numeric"] = with_sales("\nUNION ALL\n".join(
    _describe(c, s) for c, s in [("Age", 0), ("Quantity", 0), ("Unit_Price", 2), ("Total_Sales", 2)]))


def _analysis(dim: str) -> str:
    return with_sales(f"""
SELECT {dim}, CAST(rev AS DOUBLE) AS Total_Revenue, {ratio("rev", "n", **HE)} AS Avg_Order, n AS Orders,
       {rupees("rev")} AS Total_Revenue_Text, {rupees_of_ratio("rev", "n")} AS Avg_Order_Text
FROM g""", dim_cte(dim))


SQL["category_analysis"] = _analysis("Category")
SQL["city_analysis"] = _analysis("City")

SQL["product_analysis"] = with_sales(f"""
SELECT Product, CAST(rev AS DOUBLE) AS Revenue, CAST(units AS BIGINT) AS Units_Sold, ids AS Orders,
       {rupees("rev")} AS Revenue_Text
FROM g""", dim_cte("Product"))

MONTHS_CTE = ("m AS (SELECT CAST(month(Order_Date) AS INTEGER) AS Month_Num, {z} AS rev FROM sales_data "
              "WHERE Order_Date IS NOT NULL GROUP BY 1),\n"
              "months AS (SELECT CAST(range AS INTEGER) AS Month_Num FROM range(1, 13)),\n"
              "mm AS (SELECT months.Month_Num, COALESCE(m.rev, 0) AS rev FROM months LEFT JOIN m "
              "ON months.Month_Num = m.Month_Num)").format(z=ZREV)

SQL["month_of_year_trend"] = with_sales(f"""
SELECT Month_Num, strftime(make_date(2000, Month_Num, 1), '%b') AS Month, CAST(rev AS DOUBLE) AS Revenue,
       {rupees("rev")} AS Revenue_Text
FROM mm""", MONTHS_CTE)

SQL["chart_monthly_trend"] = with_sales(f"""
SELECT Month_Num - 1 AS Position, strftime(make_date(2000, Month_Num, 1), '%b') AS Month,
       CAST(rev AS DOUBLE) AS Revenue, {millions("rev")} AS Label
FROM mm""", MONTHS_CTE)

SQL["age_band_counts"] = with_sales("""
SELECT labels.Band_Index, labels.Age_Band, COUNT(b.Band_Index) AS Orders
FROM labels LEFT JOIN b ON labels.Band_Index = b.Band_Index
GROUP BY 1, 2""", """b AS (SELECT CASE WHEN Age >= 0 AND Age < 20 THEN 0 WHEN Age >= 20 AND Age < 30 THEN 1
                  WHEN Age >= 30 AND Age < 40 THEN 2 WHEN Age >= 40 AND Age < 50 THEN 3
                  WHEN Age >= 50 AND Age < 60 THEN 4 WHEN Age >= 60 AND Age < 70 THEN 5 END AS Band_Index
           FROM sales_data)""", """labels AS (SELECT * FROM (VALUES (0, '<20'), (1, '20-29'), (2, '30-39'),
           (3, '40-49'), (4, '50-59'), (5, '60+')) t(Band_Index, Age_Band))""")


def _bars(dim: str) -> str:
    return with_sales(f"""
SELECT {dim}, CAST(rev AS DOUBLE) AS Revenue, {millions("rev")} AS Label FROM g""", dim_cte(dim))


SQL["chart_category_sales"] = _bars("Category")
SQL["chart_city_sales"] = _bars("City")

SQL["product_order_share"] = with_sales(f"""
SELECT Product, rows_ AS Orders,
       {ratio("rows_", "(SELECT SUM(rows_) FROM g)", scale=1, num_scale=0, factor=100, **HE)} AS Share_Pct,
       {percent("rows_", "(SELECT SUM(rows_) FROM g)", num_scale=0, den_scale=0)} AS Share_Label
FROM g""", dim_cte("Product"))

SQL["age_histogram"] = with_sales("""
SELECT bins.Bin,
       CASE WHEN bins.Bin = 20 THEN p.l ELSE bins.Bin * p.step + p.f END AS Bin_Start,
       CASE WHEN bins.Bin + 1 = 20 THEN p.l ELSE (bins.Bin + 1) * p.step + p.f END AS Bin_End,
       COALESCE(c.Orders, 0) AS Orders,
       CASE WHEN bins.Bin * p.step + p.f < 25 THEN '< 25' WHEN bins.Bin * p.step + p.f < 40 THEN '25 – 39'
            WHEN bins.Bin * p.step + p.f < 55 THEN '40 – 54' ELSE '55 +' END AS Age_Group
FROM bins CROSS JOIN p LEFT JOIN c ON bins.Bin = c.Bin
WHERE p.f IS NOT NULL""",
    """mm AS (SELECT MIN(CAST(Age AS DOUBLE)) AS lo, MAX(CAST(Age AS DOUBLE)) AS hi FROM sales_data)""",
    """p AS (SELECT f, l, (l - f) / CAST(20 AS DOUBLE) AS step, CAST(20 AS DOUBLE) / (l - f) AS norm FROM (
           SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS f,
                  CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS l FROM mm))""",
    """i0 AS (SELECT x, f, l, step, CASE WHEN i = 20 THEN 19 ELSE i END AS i FROM (
           SELECT CAST(Age AS DOUBLE) AS x, f, l, step, CAST(floor((CAST(Age AS DOUBLE) - f) * norm) AS INTEGER) AS i
           FROM sales_data, p WHERE Age IS NOT NULL))""",
    """i1 AS (SELECT x, f, l, step,
           CASE WHEN x < (CASE WHEN i = 20 THEN l ELSE i * step + f END) THEN i - 1 ELSE i END AS i FROM i0)""",
    """i2 AS (SELECT CASE WHEN x >= (CASE WHEN i + 1 = 20 THEN l ELSE (i + 1) * step + f END) AND i <> 19
                       THEN i + 1 ELSE i END AS i FROM i1)""",
    """bins AS (SELECT CAST(range AS INTEGER) AS Bin FROM range(0, 20))""",
    """c AS (SELECT i AS Bin, COUNT(*) AS Orders FROM i2 GROUP BY i)""")

SQL["age_density"] = with_sales("""
SELECT Point, round(x, 10) AS X,
       round(SUM(c * exp(-0.5 * ((x - CAST(a AS DOUBLE)) / h) * ((x - CAST(a AS DOUBLE)) / h)))
             / (CAST(n AS DOUBLE) * h * sqrt(2 * pi())), 10) AS Density
FROM xs, vc
GROUP BY Point, x, n, h""",
    """vc AS (SELECT CAST(Age AS DECIMAL(38,0)) AS a, COUNT(*) AS c FROM sales_data WHERE Age IS NOT NULL GROUP BY 1)""",
    """s AS (SELECT CAST(SUM(c) AS HUGEINT) AS n, CAST(SUM(c * a) AS HUGEINT) AS s1,
                  CAST(SUM(c * a * a) AS HUGEINT) AS s2, CAST(MIN(a) AS DOUBLE) AS lo, CAST(MAX(a) AS DOUBLE) AS hi
           FROM vc)""",
    """k AS (SELECT n, lo, hi, CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE) AS var FROM s)""",
    """b AS (SELECT n, lo, hi, sqrt(var) * pow(CAST(n AS DOUBLE), -0.2) AS h, (hi - lo) / CAST(299 AS DOUBLE) AS step
           FROM k WHERE n >= 2 AND var > 0)""",
    """xs AS (SELECT CAST(range AS INTEGER) AS Point,
                   CASE WHEN range = 299 THEN hi ELSE CAST(range AS INTEGER) * step + lo END AS x, n, h
            FROM range(0, 300), b)""")


def _top(dim: str) -> str:
    return (f"(SELECT {dim} FROM sales_data WHERE {dim} IS NOT NULL GROUP BY {dim} "
            f"ORDER BY {ZREV} DESC, {dim} ASC LIMIT 1)")


def _top_rev(dim: str) -> str:
    return (f"(SELECT {ZREV} FROM sales_data WHERE {dim} IS NOT NULL GROUP BY {dim} "
            f"ORDER BY {ZREV} DESC, {dim} ASC LIMIT 1)")


SQL["kpi_summary"] = with_sales(f"""
SELECT CAST(rev AS DOUBLE) AS Total_Revenue, n AS Total_Orders, {ratio("rev", "n", **HE)} AS Avg_Order_Value,
       {_top("Product")} AS Top_Product, {_top("City")} AS Top_City,
       {rupees("rev", 2)} AS Total_Revenue_Text, {rupees_of_ratio("rev", "n", 2)} AS Avg_Order_Value_Text
FROM t""", f"t AS (SELECT {ZREV} AS rev, COUNT(*) AS n FROM sales_data)")

_best_month = ("(SELECT month(Order_Date) FROM sales_data WHERE Order_Date IS NOT NULL GROUP BY 1 "
               f"ORDER BY {ZREV} DESC, 1 ASC LIMIT 1)")

SQL["insights_overview"] = with_sales(f"""
SELECT n AS Total_Records, dmin AS Date_Min, dmax AS Date_Max,
       (SELECT COUNT(DISTINCT City) FROM sales_data) AS Cities,
       (SELECT {_sorted_list("City")} FROM sales_data) AS City_List,
       (SELECT COUNT(DISTINCT Category) FROM sales_data) AS Categories,
       (SELECT {_sorted_list("Category")} FROM sales_data) AS Category_List,
       (SELECT COUNT(DISTINCT Product) FROM sales_data) AS Products,
       (SELECT {_sorted_list("Product")} FROM sales_data) AS Product_List,
       CAST(rev AS DOUBLE) AS Total_Revenue, {ratio("rev", "n", **HE)} AS Avg_Order_Value,
       {_top("Category")} AS Top_Category, CAST({_top_rev("Category")} AS DOUBLE) AS Top_Category_Revenue,
       {ratio(_top_rev("Category"), "rev", scale=1, den_scale=2, factor=100, **HE)} AS Top_Category_Share_Pct,
       {_top("City")} AS Top_City, CAST({_top_rev("City")} AS DOUBLE) AS Top_City_Revenue,
       {_top("Product")} AS Top_Product, CAST({_top_rev("Product")} AS DOUBLE) AS Top_Product_Revenue,
       strftime(make_date(2000, CAST({_best_month} AS INTEGER), 1), '%B') AS Best_Month,
       {rupees("rev", 2)} AS Total_Revenue_Text, {rupees_of_ratio("rev", "n", 2)} AS Avg_Order_Value_Text,
       {millions("rev", 2, " Million")} AS Total_Revenue_Millions, {rupees_of_ratio("rev", "n", 0)} AS Avg_Order_Value_Whole,
       {millions(_top_rev("Category"), 2)} AS Top_Category_Revenue_Text,
       {millions(_top_rev("City"), 2)} AS Top_City_Revenue_Text,
       {millions(_top_rev("Product"), 2)} AS Top_Product_Revenue_Text
FROM t""", f"t AS (SELECT {ZREV} AS rev, COUNT(*) AS n, MIN(Order_Date) AS dmin, MAX(Order_Date) AS dmax "
           f"FROM sales_data)")

SQL["insights_category_breakdown"] = with_sales(f"""
SELECT Category, CAST(rev AS DOUBLE) AS Revenue, {number("rev")} AS Revenue_Text,
       {ratio("rev", f"(SELECT {ZREV} FROM sales_data)", scale=1, den_scale=2, factor=100, **HE)} AS Share_Pct
FROM g""", dim_cte("Category"))


def _revenue_table(dim: str) -> str:
    return with_sales(f"""
SELECT {dim}, CAST(rev AS DOUBLE) AS Revenue, {number("rev")} AS Revenue_Text
FROM g""", dim_cte(dim))


SQL["insights_city_breakdown"] = _revenue_table("City")
SQL["insights_product_breakdown"] = _revenue_table("Product")

SQL["named_category_share"] = with_sales(f"""
SELECT 'Electronics' AS Category, CAST(cat AS DOUBLE) AS Revenue,
       {ratio("cat", "total", scale=1, den_scale=2, factor=100, **HE)} AS Share_Pct,
       {percent("cat", "total")} AS Share_Label
FROM t""", "t AS (SELECT COALESCE(SUM(CASE WHEN Category = 'Electronics' THEN Total_Sales END), 0) AS cat, "
           f"{ZREV} AS total FROM sales_data)")

# ---------------------------------------------------------------------------
# Ingest path: what comes through CSV -> coercion -> load equals the source.
# ---------------------------------------------------------------------------

_TEXT = ["Order_ID", "Customer_ID", "Customer_Name", "Gender", "City", "Product", "Category"]


def _profile_select(cents: bool = False) -> str:
    parts = ["COUNT(*) AS Rows"]
    for c in _TEXT:
        parts += [f"COUNT({c}) AS {c}_Count", f"CAST(COALESCE(SUM(length({c})), 0) AS BIGINT) AS {c}_Chars"]
    parts += ["COUNT(Order_Date) AS Order_Date_Count", "MIN(Order_Date) AS Order_Date_Min",
              "MAX(Order_Date) AS Order_Date_Max",
              "CAST(COALESCE(SUM(dayofmonth(Order_Date)), 0) AS BIGINT) AS Order_Date_Day_Sum"]
    for c in ["Age", "Quantity"]:
        parts += [f"COUNT({c}) AS {c}_Count", f"CAST(SUM({c}) AS DOUBLE) AS {c}_Sum"]
    for c in ["Unit_Price", "Total_Sales"]:
        parts += [f"COUNT({c}) AS {c}_Count", f"CAST(SUM({c}) * 100 AS BIGINT) AS {c}_Cents" if cents else f"CAST(SUM({c}) AS DOUBLE) AS {c}_Sum"]
    return ",\n       ".join(parts)


# What the dirty CSV copy says (see ``bazaar.plans.ingest.dirty``): every row as the reports read it, and its reason.
DIRTY_CTE = """numbered AS (SELECT *, CAST(split_part(Order_ID, '-', 1) AS BIGINT) AS n FROM sales_data),
dirty AS (
  SELECT
    CASE WHEN n % 127 = 0 THEN NULL WHEN n % 131 = 0 THEN Order_ID || '-' || repeat('0', 20) ELSE Order_ID END AS Order_ID,
    CASE WHEN n % 139 <> 0 THEN Order_Date END AS Order_Date, Customer_ID, Customer_Name,
    CAST(CASE WHEN n % 107 = 0 THEN 99999999999 WHEN n % 101 = 0 THEN Age + CASE WHEN Age < 0 THEN -0.5 ELSE 0.5 END ELSE Age END AS DECIMAL(24,6)) AS Age,
    CASE WHEN n % 137 <> 0 THEN Gender END AS Gender,
    CASE WHEN n % 113 = 0 THEN repeat('x', 51) WHEN n % 151 = 0 THEN ' ' || City ELSE City END AS City,
    CASE WHEN n % 149 = 0 THEN 'Monitor 24", black' ELSE Product END AS Product, Category,
    CAST(CASE WHEN n % 103 = 0 THEN Quantity + 0.25 ELSE Quantity END AS DECIMAL(24,6)) AS Quantity, Unit_Price,
    CASE WHEN n % 109 = 0 THEN CAST(1000000000000 AS DECIMAL(18,2)) ELSE CAST(Total_Sales AS DECIMAL(18,2)) END AS Total_Sales,
    CASE WHEN n % 127 = 0 THEN 'order_id_null' WHEN n % 131 = 0 THEN 'order_id_length'
         WHEN n % 101 = 0 AND n % 107 <> 0 AND Age IS NOT NULL THEN 'fractional_age'
         WHEN n % 103 = 0 AND Quantity IS NOT NULL THEN 'fractional_quantity' WHEN n % 107 = 0 THEN 'integer_overflow'
         WHEN n % 109 = 0 THEN 'money_overflow' WHEN n % 113 = 0 THEN 'text_length' END AS Reason
  FROM numbered),
valid AS (SELECT * FROM dirty WHERE Reason IS NULL)"""

SQL["csv_roundtrip"] = with_sales(f"SELECT {_profile_select()}\nFROM valid", DIRTY_CTE)
SQL["source_fallback"] = with_sales(f"SELECT 'csv' AS Source, {_profile_select(cents=True)}\nFROM dirty", DIRTY_CTE)

SQL["full_refresh_load"] = with_sales("""
SELECT COUNT(*) AS Rows, COUNT(Total_Sales) AS Sales, CAST(SUM(Total_Sales) AS DOUBLE) AS Total_Sales_Sum
FROM valid""", DIRTY_CTE)

SQL["load_reconciliation"] = with_sales("""
SELECT COUNT(*) AS Source_Rows, COUNT(*) - COUNT(Reason) AS Loaded_Rows, COUNT(Reason) AS Quarantined_Rows, true AS Reconciled
FROM dirty""", DIRTY_CTE)

SQL["quarantine_counts"] = with_sales("""
SELECT o.Outcome, (SELECT COUNT(*) FROM dirty d WHERE coalesce(d.Reason, 'valid') = o.Outcome) AS Rows
FROM (VALUES ('valid'), ('malformed'), ('order_id_null'), ('order_id_length'), ('fractional_age'), ('fractional_quantity'),
             ('integer_overflow'), ('money_overflow'), ('text_length')) o(Outcome)""", DIRTY_CTE)

SQL["surrogate_key"] = with_sales("""
SELECT COUNT(*) AS Rows, COUNT(*) AS Distinct_Ids, CAST(1 AS BIGINT) AS Min_Id, COUNT(*) AS Max_Id
FROM valid""", DIRTY_CTE)

SQL["source_order_ids"] = with_sales(f"""
SELECT row_number() OVER (ORDER BY {", ".join(f"{c} NULLS FIRST" for c in _cols)}) AS id,
       Order_ID, Order_Date, Product, CAST(Total_Sales AS DOUBLE) AS Total_Sales
FROM sales_data""")

SQL["date_format_choice"] = with_sales("""
SELECT 'dd/MM/yyyy' AS Date_Format, CASE WHEN n % 139 <> 0 AND n % 149 <> 0 THEN Order_Date END AS Order_Date, COUNT(*) AS Orders
FROM numbered GROUP BY 2""", "numbered AS (SELECT *, CAST(split_part(Order_ID, '-', 1) AS BIGINT) AS n FROM sales_data)")

SQL["sales_density"] = with_sales("""
SELECT Point, round(x, 6) AS X, round(SUM(c * exp(-0.5 * ((x - a) / h) * ((x - a) / h))) / (n * h * sqrt(2 * pi())), 8) AS Density
FROM xs, vc GROUP BY Point, x, n, h""",
    "vc AS (SELECT CAST(Total_Sales AS DOUBLE) AS a, COUNT(*) AS c FROM sales_data WHERE Total_Sales IS NOT NULL GROUP BY 1)",
    """b AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS h, (hi - lo) / CAST(299 AS DOUBLE) AS step FROM (
           SELECT CAST(COUNT(Total_Sales) AS DOUBLE) AS n, CAST(MIN(Total_Sales) AS DOUBLE) AS lo, CAST(MAX(Total_Sales) AS DOUBLE) AS hi,
                  stddev_samp(CAST(Total_Sales AS DOUBLE)) AS sd FROM sales_data) WHERE n >= 2 AND sd > 0)""",
    """xs AS (SELECT CAST(range AS INTEGER) AS Point, CASE WHEN range = 299 THEN hi ELSE CAST(range AS INTEGER) * step + lo END AS x, n, h
            FROM range(0, 300), b)""")


SQL["customers_rollup"] = with_sales(f"""
SELECT CASE WHEN set_ = 7 THEN 'City' WHEN set_ = 11 THEN 'Category' WHEN set_ = 13 THEN 'Gender' WHEN set_ = 14 THEN 'Month_Num' ELSE 'All' END AS Dimension,
       coalesce(City, Category, Gender, Month_Num) AS Key, Total_Revenue_INR, Total_Orders, Unique_Customers
FROM (SELECT City, Category, Gender, Month_Num, GROUPING(City, Category, Gender, Month_Num) AS set_, {REV} AS Total_Revenue_INR,
             COUNT(*) AS Total_Orders, COUNT(DISTINCT Customer_ID) AS Unique_Customers
      FROM (SELECT *, CAST(month(Order_Date) AS VARCHAR) AS Month_Num FROM sales_data)
      GROUP BY GROUPING SETS ((City), (Category), (Gender), (Month_Num), ()))""")
