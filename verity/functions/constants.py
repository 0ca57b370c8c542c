"""Fixed values the engine must share with the tool it re-implements.

Every list below is a FIXED VALUE: the words, patterns and numbers have to be
exactly these for the inspection and repair results to agree.  Order matters
where noted (rating words are scanned in order, first hit wins).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — patterns
# ---------------------------------------------------------------------------

# E-mail validity.  The last class is written "[a-zA-Z0-9.-]" (same set as the
# original "[a-zA-Z0-9-.]", but portable to Java and RE2).
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"

# Date shapes, in detection order: (regex, strptime format, Spark parse pattern).
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d", "yyyy-M-d"),
    (r"^\d{2}/\d{2}/\d{4}$", "%m/%d/%Y", "M/d/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "%m-%d-%Y", "M-d-yyyy"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "%d.%m.%Y", "d.M.yyyy"),
    (r"^\d{4}/\d{2}/\d{2}$", "%Y/%m/%d", "yyyy/M/d"),
]
ISO_FORMAT = "%Y-%m-%d"

# Currency text: optional symbol, digits with commas, optional decimals.
CURRENCY_PATTERN = r"^[$€£¥₹]?\s*([\d,]+\.?\d*)\s*$"

# ---------------------------------------------------------------------------
# FIXED VALUES — column roles (matched on the lower-cased, "_"-joined name)
# ---------------------------------------------------------------------------
CRITICAL_COLS = ("rating", "performance_rating", "score", "grade", "review",
                 "eval", "evaluation", "stars", "salary", "compensation", "pay")
NAME_COLS = ("name", "first", "last", "firstname", "lastname", "fullname",
             "full_name", "first_name", "last_name", "employee_name", "emp_name")
EMAIL_COLS = ("email", "work_email", "mail", "e_mail", "email_address")
ID_COLS = ("id", "emp_id", "employee_id", "user_id", "uid", "record_id")
DATE_COLS = ("date", "hire_date", "start_date", "end_date", "dob", "birth_date",
             "join_date", "created_at", "updated_at", "termination_date")
PHONE_COLS = ("phone", "telephone", "mobile", "cell", "phone_number", "contact")

# Words that mark a critical column as a rating column (rule F4).
RATING_NAME_WORDS = ("rating", "performance", "score", "eval", "grade", "stars")

# Words that mark a column as holding e-mail for the validity inspector.
EMAIL_NAME_WORDS = ("email", "mail")

# ---------------------------------------------------------------------------
# FIXED VALUES — rating words in scan order (first hit wins) and their values
# ---------------------------------------------------------------------------
RATING_WORDS = [
    ("excellent", 5.0), ("outstanding", 5.0), ("exceptional", 5.0),
    ("very good", 4.5), ("above average", 4.5), ("superior", 4.5),
    ("good", 4.0), ("proficient", 4.0), ("competent", 4.0),
    ("satisfactory", 3.5), ("adequate", 3.5), ("acceptable", 3.5),
    ("average", 3.0), ("meets expectations", 3.0), ("standard", 3.0),
    ("fair", 2.5), ("below average", 2.5), ("marginal", 2.5),
    ("needs improvement", 2.0), ("poor", 2.0), ("developing", 2.0),
    ("unsatisfactory", 1.5), ("unacceptable", 1.5),
    ("failing", 1.0), ("critical", 1.0),
]

# Label for each rating value: the title-cased last word listed for it.
RATING_LABELS = [
    (1.0, "Critical"), (1.5, "Unacceptable"), (2.0, "Developing"),
    (2.5, "Marginal"), (3.0, "Standard"), (3.5, "Acceptable"),
    (4.0, "Competent"), (4.5, "Superior"), (5.0, "Exceptional"),
]
RATING_LABEL_DEFAULT = "Average"

# ---------------------------------------------------------------------------
# FIXED VALUES — booleans, null sentinels, e-mail domain typos, particles
# ---------------------------------------------------------------------------
BOOLEAN_TRUE = ("yes", "y", "true", "1", "t", "on", "active", "enabled")
BOOLEAN_FALSE = ("no", "n", "false", "0", "f", "off", "inactive", "disabled")

NULL_SENTINELS = ("", "null", "none", "n/a", "na", "nan", "-", "--",
                  "missing", "undefined", "unknown", "nil", "tbd")

DOMAIN_FIXES = [
    ("gmial.com", "gmail.com"), ("gmal.com", "gmail.com"),
    ("gmaill.com", "gmail.com"), ("gamil.com", "gmail.com"),
    ("gnail.com", "gmail.com"), ("gmail.con", "gmail.com"),
    ("yahooo.com", "yahoo.com"), ("yaho.com", "yahoo.com"),
    ("yahoo.con", "yahoo.com"), ("hotmal.com", "hotmail.com"),
    ("hotmial.com", "hotmail.com"), ("hotmail.con", "hotmail.com"),
    ("outlok.com", "outlook.com"), ("outllook.com", "outlook.com"),
    ("outlook.con", "outlook.com"),
]

NAME_PARTICLES = ("van", "de", "der", "den", "von", "del", "di", "da",
                  "la", "le", "les", "du", "des", "al", "el", "bin", "binti")

TO_BE_DETERMINED = "TO_BE_DETERMINED"

# ---------------------------------------------------------------------------
# FIXED VALUES — scoring
# ---------------------------------------------------------------------------
CATEGORY_WEIGHTS = [("completeness", 0.30), ("uniqueness", 0.20),
                    ("consistency", 0.20), ("accuracy", 0.15), ("format", 0.15)]
FIXED_COST = {"critical": 8.0, "warning": 3.0, "info": 0.5}
ROW_SCALE = {"critical": 1.50, "warning": 0.60, "info": 0.15}
PENALTY_CATEGORIES = ("consistency", "accuracy", "format")
SEVERITY_ORDER = ("critical", "warning", "info")

# Caps that are part of the behaviour, not a shortcut.
CELLS_PER_ISSUE = 100
DIGEST_ISSUES = 30
HISTORY_PER_USER = 50
