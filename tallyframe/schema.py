"""Ledger types and fixed value lists."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = "decimal(16,2)"
# sum() over MONEY widens by ten digits; every total is pinned to this type.
TOTAL = "decimal(26,2)"

INCOME = "INCOME"
OUTCOME = "OUTCOME"

# The allowed members of every enumerated column.
ENUMS = {
    "type": ["INCOME", "OUTCOME"],
    "frequency": ["daily", "weekly", "monthly", "yearly"],
    "account_type": ["BANK", "CASH", "CREDIT_CARD", "INVESTMENT", "SAVINGS", "WALLET"],
    "period_type": ["MONTHLY", "QUARTERLY", "YEARLY", "CUSTOM"],
    "action": ["INSERT", "UPDATE", "DELETE"],
}

# System category keys and their labels (English, Russian).
OUTCOME_CATEGORY_LABELS = {
    "food_dining": ("Food & Dining", "Еда и рестораны"),
    "transportation": ("Transportation", "Транспорт"),
    "shopping": ("Shopping", "Покупки"),
    "bills_utilities": ("Bills & Utilities", "Счета и коммунальные услуги"),
    "entertainment": ("Entertainment", "Развлечения"),
    "healthcare": ("Healthcare", "Здравоохранение"),
    "education": ("Education", "Образование"),
    "travel": ("Travel", "Путешествия"),
    "personal_care": ("Personal Care", "Личная гигиена"),
    "gifts_donations": ("Gifts & Donations", "Подарки и пожертвования"),
    "home_garden": ("Home & Garden", "Дом и сад"),
    "insurance": ("Insurance", "Страхование"),
    "taxes": ("Taxes", "Налоги"),
    "other_expenses": ("Other Expenses", "Прочие расходы"),
}
INCOME_CATEGORY_LABELS = {
    "salary": ("Salary", "Зарплата"),
    "freelance": ("Freelance", "Фриланс"),
    "investment": ("Investment", "Инвестиции"),
    "rental_income": ("Rental Income", "Арендный доход"),
    "business": ("Business", "Бизнес"),
    "gifts": ("Gifts", "Подарки"),
    "other_income": ("Other Income", "Прочие доходы"),
}

# Display labels of the other enumerations.
ACCOUNT_TYPE_LABELS = {
    "BANK": "Bank Account",
    "CASH": "Cash",
    "CREDIT_CARD": "Credit Card",
    "INVESTMENT": "Investment Account",
    "SAVINGS": "Savings Account",
    "WALLET": "Digital Wallet",
}
PERIOD_LABELS = {
    "MONTHLY": "Monthly",
    "QUARTERLY": "Quarterly",
    "YEARLY": "Yearly",
    "CUSTOM": "Custom Period",
}

# Currencies present after seeding (name, symbol).
SEED_CURRENCIES = [
    ("US Dollar", "USD"),
    ("Euro", "EUR"),
    ("Russian Ruble", "RUB"),
    ("British Pound", "GBP"),
    ("Japanese Yen", "JPY"),
    ("Canadian Dollar", "CAD"),
    ("Australian Dollar", "AUD"),
    ("Swiss Franc", "CHF"),
    ("Chinese Yuan", "CNY"),
    ("Indian Rupee", "INR"),
    ("Brazilian Real", "BRL"),
    ("South Korean Won", "KRW"),
    ("Mexican Peso", "MXN"),
    ("Singapore Dollar", "SGD"),
    ("Hong Kong Dollar", "HKD"),
    ("Norwegian Krone", "NOK"),
    ("Swedish Krona", "SEK"),
    ("Turkish Lira", "TRY"),
    ("Polish Zloty", "PLN"),
    ("Czech Koruna", "CZK"),
]

# The plain system categories of the full reset (name, type).
RESET_CATEGORIES = [
    ("Food", OUTCOME),
    ("Transport", OUTCOME),
    ("Housing", OUTCOME),
    ("Utilities", OUTCOME),
    ("Healthcare", OUTCOME),
    ("Clothing", OUTCOME),
    ("Entertainment", OUTCOME),
    ("Education", OUTCOME),
    ("Gifts", OUTCOME),
    ("Electronics", OUTCOME),
    ("Beauty & Care", OUTCOME),
    ("Sports & Fitness", OUTCOME),
    ("Travel", OUTCOME),
    ("Communication", OUTCOME),
    ("Taxes", OUTCOME),
    ("Insurance", OUTCOME),
    ("Other", OUTCOME),
    ("Salary", INCOME),
    ("Freelance", INCOME),
    ("Investments", INCOME),
    ("Gifts", INCOME),
    ("Tax Refund", INCOME),
    ("Interest", INCOME),
    ("Rental Income", INCOME),
    ("Sale", INCOME),
    ("Other", INCOME),
]

# Descriptions drawn by the transaction generator.
INCOME_DESCRIPTIONS = [
    "Salary payment",
    "Freelance work",
    "Investment return",
    "Gift received",
    "Bonus payment",
    "Rental income",
    "Business income",
    "Refund",
]
OUTCOME_DESCRIPTIONS = [
    "Grocery shopping",
    "Restaurant",
    "Transportation",
    "Shopping",
    "Bills payment",
    "Entertainment",
    "Healthcare",
    "Education",
    "Travel",
    "Personal care",
    "Gifts",
    "Home & Garden",
    "Insurance",
    "Taxes",
]

# Fixed value: what the recurring job appends to a description.
RECURRING_SUFFIX = " (автоматически создано)"

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

PAGE_SIZE = 50
NAME_LENGTHS = {"category": 50, "account": 100, "budget": 100, "description": 255}

CATEGORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("is_system", T.BooleanType()),
    T.StructField("user_id", T.LongType()),
])
CURRENCY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("symbol", T.StringType()),
])
TRANSACTION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DecimalType(16, 2)),
    T.StructField("date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("account_id", T.LongType()),
])
ACCOUNT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("balance", T.DecimalType(26, 2)),
    T.StructField("initial_balance", T.DecimalType(16, 2)),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
])
BUDGET = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("period_type", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("total_expense_limit", T.DecimalType(16, 2)),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("user_id", T.LongType()),
])
LIMIT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("budget_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("limit_amount", T.DecimalType(16, 2)),
])
RECURRING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("amount", T.DecimalType(16, 2)),
    T.StructField("type", T.StringType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
])
USER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("currency_id", T.LongType()),
])
# What the recurring job made: the rows with their template, and the days it has done.
RECURRING_LOG = T.StructType([T.StructField("recurring_id", T.LongType()), *TRANSACTION.fields])
RECURRING_DAY = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("created_count", T.LongType()),
])
