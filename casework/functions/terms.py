"""Word lists, codes and fixed texts that decide results."""

# The intents, in label-code order.
LABEL_CODES = {
    "1": "account_security",
    "2": "hardware_repair",
    "3": "software_troubleshooting",
    "4": "billing_purchases",
    "5": "device_connectivity",
    "6": "general_inquiry",
    "7": "other",
}
INTENTS = tuple(LABEL_CODES.values())

# Decision statuses, class names, thresholds and sizes.
ESCALATED = "escalated"
AUTO_HANDLED = "auto_handled"
ESCALATE_CLASS = "escalate"
REPLY_CLASS = "auto-reply"
CONFIDENCE_THRESHOLD = 0.60
MAX_MESSAGE_CHARS = 1000
MAX_REPLY_CHARS = 280
MIN_TWEET_CHARS = 15
REPLY_SAMPLE = 5000
THREAD_SAMPLE = 2000
GOLDEN_ROWS = 200
JUDGE_ROWS = 10
NEIGHBOURS = 5
EXTRACT_SEED = 42
SPLIT_SEED = 101

# Reason texts.
REASON_DAMAGE = "Physical hardware damage"
REASON_BILLING = "Refund or disputed charge/payment issue"
REASON_PII = "Customer message contains possible PII"
REASON_TOXIC = "Highly frustrated or toxic customer"
REASON_SAFE = "Safe for auto-reply"
REASON_MISSING = "Escalation Required"
NO_EXAMPLES = "No historical examples were retrieved."

# Spellings of true, per reader of the result table.
TRUE_WORDS = {
    "harness": ("true", "1", "yes", "y", "t"),
    "dashboard": ("true", "1", "yes", "y"),
}

# Safety-signal terms.
DAMAGE_TERMS = (
    "cracked screen", "broken screen", "water damage", "water damaged", "dropped my phone",
    "broken button", "swollen battery", "bloated battery", "physical damage", "damaged screen",
)
CHARGE_TERMS = (
    "refund", "charged", "charge", "charged me", "billing", "payment", "subscription",
    "money back", "didn't buy", "did not buy",
)
TOXIC_TERMS = (
    "fuck", "fucking", "shit", "useless", "idiot", "stupid", "terrible", "worst", "hate",
)
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d[\d\s().-]{7,}\d)\b"

# Keyword-baseline terms, in deciding order.
INTENT_TERMS = {
    "account_security": (
        "password", "forgot password", "reset password", "locked out", "account locked",
        "login", "log in", "sign in", "apple id", "apple account", "account recovery",
        "can't access my account", "cannot access my account",
    ),
    "hardware_repair": (
        "cracked screen", "broken screen", "screen cracked", "screen broken",
        "cracked display", "broken display", "water damage", "water damaged",
        "dropped my iphone", "dropped my phone", "physical damage", "damaged iphone",
        "damaged phone", "swollen battery", "battery swollen", "battery bulging",
        "won't turn on", "wont turn on", "doesn't turn on", "doesnt turn on",
    ),
    "billing_purchases": (
        "refund", "refund me", "charged", "charge", "charged twice", "wrong charge",
        "incorrect charge", "unknown charge", "unauthorized charge", "billing", "bill",
        "payment", "purchase", "purchased", "subscription", "money back", "payment issue",
        "app i didn't buy", "app i did not buy",
    ),
    "device_connectivity": (
        "wifi", "wi-fi", "wireless", "bluetooth", "hotspot", "cellular", "mobile data",
        "network", "connection", "connect", "connecting", "airdrop", "internet connection",
        "can't connect", "cannot connect", "won't connect", "wont connect",
    ),
    "software_troubleshooting": (
        "software", "ios", "ios update", "update", "latest update", "bug", "glitch", "crash",
        "crashing", "crashed", "freezing", "frozen", "app not working",
        "application not working", "keeps crashing", "keeps freezing", "system error",
        "error message",
    ),
    "other": (
        "legal", "lawsuit", "press", "media", "complaint", "feedback", "suggestion",
    ),
}
DEFAULT_INTENT = "general_inquiry"

# Keyword-baseline terms that ask for a human.
ESCALATE_TERMS = (
    "refund", "money back", "charged twice", "wrong charge", "incorrect charge",
    "unauthorized charge", "fraud", "dispute", "charge i don't recognize",
    "charge i do not recognize",
    "cracked screen", "broken screen", "screen cracked", "screen broken", "water damage",
    "water damaged", "swollen battery", "battery swollen", "physical damage",
    "dropped my iphone", "dropped my phone",
    "fuck", "fucking", "shit", "terrible", "horrible", "furious", "angry", "ridiculous",
    "worst", "unacceptable",
    "@gmail.com", "@yahoo.com", "@outlook.com", "@hotmail.com", "phone number",
    "my number is", "my email is",
)

# Marks of failed requests (model marks are read before quota marks).
MODEL_ERROR_TERMS = (
    "model_unavailable", "model is currently unavailable", "model unavailable",
)
QUOTA_ERROR_TERMS = (
    "429", "rate limit", "rate_limit", "too many requests", "quota", "insufficient quota",
    "limit exceeded", "tpm", "rpm",
)


def shortest(terms):
    """Drop terms that contain another listed term: the shorter one already decides."""
    return tuple(t for t in terms if not any(o != t and o in t for o in terms))
