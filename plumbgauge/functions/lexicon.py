"""Word lists, patterns and labels that decide results."""

# Column-role words (substring tests on the lower-cased column name).
DATE_WORDS = ["date", "time", "timestamp"]
ID_EXACT = ["id", "sku"]
ID_AFFIXES = ["id", "uuid", "sku"]
ID_WORDS = ["sku", "serial", "code", "batch", "invoice", "transaction", "order", "distributor",
            "customer", "sale", "key", "number"]
ID_METRIC_VETO = ["revenue", "sales", "qty", "quantity", "profit", "amount", "cost", "cogs",
                  "unit_price", "price", "margin", "discount"]
ID_ATTRIBUTE_VETO = ["age", "salary", "bmi", "rating", "score", "temp", "temperature", "gender",
                     "sex", "abv", "percent", "percentage"]
METRIC_WORDS = ["revenue", "sales", "units_sold", "quantity", "qty", "profit", "amount", "cost",
                "cogs", "unit_price", "price", "margin", "discount"]
ATTRIBUTE_WORDS = ["age", "salary", "bmi", "rating", "score", "temp", "temperature", "gender",
                   "sex", "abv", "percent", "percentage", "height", "weight", "income"]
DIMENSION_WORDS = ["region", "country", "state", "city", "category", "department", "segment",
                   "territory", "product_type", "type", "product", "channel", "retailer", "store",
                   "brand", "model", "group", "status", "name", "desc", "description", "industry",
                   "location", "address", "zip", "postal"]

# Dataset-type words, in order of precedence on ties.
DATASET_TYPES = {
    "Sales Dataset": ["sales", "units_sold", "retailer", "discount", "channel", "cogs", "revenue",
                      "order", "price", "unit_price"],
    "Financial Dataset": ["profit", "revenue", "cogs", "cost", "margin", "tax", "income", "expense",
                          "budget", "finance"],
    "Inventory Dataset": ["stock", "sku", "inventory", "warehouse", "batch", "supply",
                          "quantity_on_hand", "reorder"],
    "Healthcare Dataset": ["patient", "health", "bmi", "diagnosis", "treatment", "doctor", "clinic",
                           "medical", "disease"],
    "HR Dataset": ["employee", "salary", "wage", "hire_date", "job", "department", "performance",
                   "recruitment", "payroll"],
    "Customer Dataset": ["customer", "gender", "age", "rating", "feedback", "satisfaction",
                         "review", "email", "phone"],
    "Manufacturing Dataset": ["manufacturing", "machine", "sensor", "pressure", "temperature",
                              "temp", "defect", "operator", "line", "production"],
}
DEFAULT_DATASET_TYPE = "General Dataset"

# Names that are dimensions whatever their type.
KNOWN_DIMENSIONS = ["region", "country", "state", "city", "category", "department", "channel",
                    "product_type", "segment", "territory", "gender", "age_group", "customer_type"]

# Profiling rules.
NEAR_DUPLICATE_SKIP_WORDS = ["id", "date", "time", "timestamp", "index", "key"]
CATEGORY_SKIP_WORDS = ["id", "date", "time", "timestamp", "batch", "serial", "code", "key",
                       "index", "email", "phone"]
PROFILE_NEGATIVE_WORDS = ["price", "salary", "quantity"]
PROFILE_DATE_WORDS = ["date", "day", "month", "year", "time"]
FORMATTED_NUMBER = r"^\s*[\$\-\+\€\£]?\s*\d{1,3}(,\d{3})*(\.\d+)?\s*[\%]?\s*$"

# Cleaning rules.
NEGATIVE_WORDS = ["price", "salary", "quantity", "unit", "revenue", "sales", "cogs", "profit"]
NUMERIC_NAME_WORDS = ["age", "price", "salary", "quantity", "unit", "revenue", "sales", "amount",
                      "total", "abv", "cogs", "profit"]
TRUE_WORDS = ["yes", "true", "t", "1"]
FALSE_WORDS = ["no", "false", "f", "0"]
PROTECTED_UPPERCASE = ["IPA", "ABV", "SKU", "ID", "URL", "ISBN", "UUID"]
FLAG_COLUMNS = ["is_outlier", "is_derived"]
# Date texts in the order they are tried: the shape of the text, and the format, or nothing where a plain cast reads it.
# Between slashes the month comes first, and the day where no month fits.
DATE_SHAPES = [
    (r"\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?", None),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?", "M/d/yyyy H:mm[:ss]"), (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?", "d/M/yyyy H:mm[:ss]"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"), (r"\d{1,2}/\d{1,2}/\d{2}", "d/M/yy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}(:\d{2})?", "yyyy/M/d H:mm[:ss]"), (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"),
    (r"(19|20)\d{6}", "yyyyMMdd"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"), (r"[A-Za-z]{3,9} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"), (r"\d{1,2} [A-Za-z]{3,9} \d{4}", "d MMMM yyyy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"), (r"\d{1,2}-[A-Za-z]{3}-\d{2}", "d-MMM-yy"),
]

# Words that stand for a missing value in a delimited file.
MISSING_AT_LOAD = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                   "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Names of the cleaning actions.
ACTION_NAMES = {"duplicates": "remove_exact_duplicates", "boolean": "standardize_boolean", "gender": "standardize_gender",
                "casing": "standardize_casing_title_case", "invalid": "null_invalid_values", "outliers": "flag_outliers",
                "unknown": "impute_dimension_unknown", "fill": "impute_attribute_median", "merge": "merge_similar_categories"}

# Weights of the quality score.
WEIGHT_BY_NAME = {"revenue": 10, "units_sold": 10, "profit": 10, "transaction_date": 10,
                  "region": 5, "category": 5, "department": 5,
                  "sale_id": 1, "customer_id": 1, "batch_number": 1}
WEIGHT_BY_ROLE = {"IDENTIFIER": 1, "BUSINESS_METRIC": 10, "DATE": 10, "DIMENSION": 5, "ATTRIBUTE": 5}

# KPI column aliases.
KPI_ALIASES = {
    "revenue": ["revenue", "sales", "total_revenue", "amount"],
    "units_sold": ["units_sold", "units", "quantity_sold"],
    "quantity": ["quantity", "qty"],
    "profit": ["profit", "net_profit"],
}
UNITS_ALIASES = ["units_sold", "units", "quantity_sold", "quantity", "qty", "volume",
                 "number_of_units"]
REVENUE_ALIASES = ["revenue", "sales", "total_revenue", "amount", "total_amount", "grand_total",
                   "price_total"]

# Missing-key words and the label they get.
MISSING_WORDS = ["none", "nan", "unknown"]
UNASSIGNED_PREFIX = "⚠️ Unassigned"
ORPHAN_QUESTION = "System Query"

# Other chart types on offer next to the recommended one.
CHART_ALTERNATIVES = {
    "table": ["table"],
    "date and number": ["line", "bar", "area", "scatter"],
    "category and number": ["bar", "pie", "area", "scatter", "treemap", "waterfall"],
    "two numbers": ["scatter", "line", "bar", "box"],
    "other": ["bar", "line", "pie", "scatter", "heatmap"],
}
