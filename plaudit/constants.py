"""Fixed values of the review model. Every one can be overridden by an argument."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# They decide results, so they are stated literally.
# ---------------------------------------------------------------------------

SECTORS = (
    "Animals & Pets",
    "Restaurants & Bars",
    "Public & Local Services",
    "Shopping & Fashion",
    "Media & Publishing",
    "Legal Services & Government",
    "Money & Insurance",
    "Vehicles & Transportation",
    "Utilities",
    "Sports",
    "Travel & Vacation",
    "Education & Training",
    "Electronics & Technology",
    "Construction & Manufacturing",
    "Events & Entertainment",
    "Beauty & Well-being",
    "Business Services",
    "Home & Garden",
    "Home Services",
    "Health & Medical",
    "Food, Beverages & Tobacco",
    "Hobbies & Crafts",
)

HTML_ENTITIES = (
    ("&amp;", "&"),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
)

KEPT_PUNCTUATION = ".,!?'-"
TOKEN_EDGE_PUNCTUATION = ".,!?:;\"'"

TOPIC_SEEDS = {
    "Delivery & Shipping": (
        "delivery", "shipping", "dispatch", "courier", "parcel", "package", "arrived",
        "tracked", "transit", "postage", "next day", "same day", "delivered", "shipment",
        "not arrived", "missing", "late", "delayed", "waiting", "still waiting",
        "never arrived", "weeks", "days",
    ),
    "Order & Purchase Process": (
        "order", "purchase", "checkout", "bought", "buying", "placed order", "online order",
        "transaction", "ordered", "easy purchase", "ordering process", "confirmation",
        "order placed", "add to cart", "basket", "payment", "invoice", "receipt",
        "process smooth",
    ),
    "Returns, Refunds & Cancellations": (
        "refund", "return", "cancellation", "cancelled", "money back", "reimbursement",
        "reversed", "chargeback", "exchange", "send back", "returned item", "refunded",
        "dispute", "compensation", "credit", "void", "rejected return", "refused refund",
        "waiting refund",
    ),
    "Customer Service & Support": (
        "customer service", "support", "helpdesk", "agent", "staff", "representative",
        "call centre", "response", "replied", "helpful team", "contact", "communicate",
        "assistance", "rude", "unhelpful", "ignored", "no reply", "email", "phone call",
        "live chat", "waiting time", "hold", "spoke", "told", "advised", "promised",
    ),
    "Product Quality & Condition": (
        "quality", "condition", "build", "durable", "reliable", "product quality",
        "well made", "broken", "faulty", "defective", "damaged", "poor quality",
        "excellent condition", "refurbished", "second hand", "scratched", "incomplete",
        "missing parts", "wrong item", "not as described", "like new", "grade", "tested",
    ),
    "Price & Value": (
        "price", "value", "affordable", "expensive", "cost", "worth", "cheap", "overpriced",
        "discount", "deal", "money", "competitive price", "good value", "pricing", "fee",
        "charge", "quoted", "paid", "saving", "budget",
    ),
    "Website & Online Experience": (
        "website", "app", "online", "interface", "navigation", "checkout page",
        "user experience", "loading", "error", "login", "account", "platform", "digital",
        "easy to use", "page", "link", "browser", "mobile", "desktop", "slow", "crashed",
        "glitch", "update", "password",
    ),
    "Repair & Technical Service": (
        "repair", "fix", "technician", "engineer", "diagnostic", "fault", "broken device",
        "service centre", "technical", "warranty repair", "maintenance", "replaced part",
        "booked", "appointment", "turnaround", "quote", "assessed", "inspected",
        "under warranty", "out of warranty",
    ),
}

OTHER_TOPIC = "General / Other"
OTHER_TOPIC_ID = -1
SIMILARITY_THRESHOLD = 0.05

STOP_WORDS = (
    "the", "and", "for", "was", "are", "has", "had", "have", "been", "with",
    "this", "that", "they", "from", "not", "but", "its", "our", "your",
    "their", "all", "just", "very", "also", "more", "than", "did", "one",
    "got", "get", "can", "it", "is", "in", "to", "of", "a", "an", "on", "at",
    "be", "my", "we", "i", "me", "he", "she", "us", "you", "so", "if", "or",
    "as", "by", "do", "no", "up", "out", "his", "her", "him", "who", "what",
    "how", "would", "could", "should", "still", "even", "then", "when",
)
MIN_TOKEN_LENGTH = 4

POSITIVE_SCORE, NEUTRAL_SCORE, NEGATIVE_SCORE = 0.95, 0.70, 0.95
SENTIMENT_NUMBERS = {"positive": 1, "neutral": 0, "negative": -1}
RED_BELOW, AMBER_BELOW = -25.0, 0.0
WEAK_GAP = -5.0
MIN_TARGET_REVIEWS = 10
FULL_COMPANY_REVIEWS = 100

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

TEXT_COLUMNS = ("title", "review", "description")
REQUIRED_COLUMNS = ("category", "company", "stars")
