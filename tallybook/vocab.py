"""Fixed vocabularies of the ledger engine.

FIXED VALUES: the word lists below define results, so they have to stay as they
are for two runs of the engine (or two engines) to agree.  Every function that
uses one of them also takes it as a parameter.
"""

CURRENCY = "₹"
TOP_K = 10
EMBEDDING_DIM = 64
UNCATEGORIZED = "Uncategorized"

CATEGORIES = [
    "Food & Dining", "Groceries", "Shopping", "Transport", "Utilities",
    "Rent/Housing", "Healthcare", "Entertainment", "Subscriptions",
    "Savings/Transfer", "Income", "Other", "Uncategorized",
]

NON_SPENDING = ["Income", "Savings/Transfer"]

# Statement headers (lower case) accepted for each ledger column.
COLUMN_ALIASES = {
    "date": ["date", "transaction date", "trans date", "posted date", "value date"],
    "description": ["description", "merchant", "payee", "details", "narrative", "memo"],
    "amount": ["amount", "debit", "credit", "transaction amount", "value"],
}

# FIXED VALUES: category keywords, whole and in their order, checked from top to bottom;
# the first category with a keyword inside the lower-cased description wins.
RULES = {
    "Income": [
        "salary credit", "salary", "payroll", "freelance payment", "client payment",
        "neft credit", "imps credit", "upi credit", "interest earned", "dividend",
        "refund", "cashback",
    ],
    "Savings/Transfer": [
        "mutual fund sip", "sip transfer", "transfer to savings", "savings transfer",
        "transfer to", "account transfer", "internal transfer", "wire transfer",
    ],
    "Rent/Housing": [
        "rent payment", "rent", "apartment", "lease payment", "home loan emi",
        "housing society", "maintenance charges", "society maintenance",
    ],
    "Groceries": [
        "bigbasket", "dmart", "d-mart", "grofers", "blinkit", "zepto", "jiomart",
        "more megastore", "reliance fresh", "reliance smart", "spencer",
        "nature's basket", "lulu hypermarket", "star bazaar", "hypercity", "grocery",
        "groceries", "supermarket", "kirana", "vegetables", "fruits and vegetables",
        "mart", "provision shop", "veggie shop", "vegetable shop", "grocery shop",
        "provisions", "bazaar",
    ],
    "Food & Dining": [
        "zomato", "swiggy", "box8", "faasos", "freshmenu", "rebel foods", "eatfit",
        "mcdonald", "kfc india", "burger king india", "domino", "pizza hut india",
        "subway india", "barbeque nation", "mainland china", "paradise biryani",
        "barbeque", "starbucks", "chai point", "cafe coffee day", "ccd",
        "third wave coffee", "blue tokai", "restaurant", "dining", "bistro", "dhaba",
        "hotel", "tiffin", "mess", "food delivery", "meal delivery", "valentine",
    ],
    "Transport": [
        "ola cabs", "ola ", "uber india", "uber ", "rapido", "namma yatri", "yulu",
        "bounce", "bluesmart", "metro rail", "bmtc", "best bus", "dtc bus", "ksrtc",
        "bus pass", "fastag", "toll plaza", "parking", "indian oil", "iocl",
        "hp petrol", "bharat petroleum", "bpcl", "shell india", "petrol pump",
        "fuel station", "irctc", "redbus", "abhibus", "makemytrip flight",
        "indigo airlines", "air india", "spicejet",
    ],
    "Utilities": [
        "bescom", "msedcl", "tata power", "adani electricity", "electricity bill",
        "electric bill", "water bill", "gas bill", "piped gas", "mgl", "igl",
        "airtel broadband", "airtel fiber", "jio fiber", "act fibernet", "hathway",
        "bsnl broadband", "broadband", "internet bill", "postpaid bill",
    ],
    "Subscriptions": [
        "netflix", "spotify", "hotstar", "disney+ hotstar", "amazon prime", "zee5",
        "sony liv", "sonyliv", "voot", "mxplayer", "youtube premium", "google one",
        "google play", "microsoft 365", "adobe", "dropbox", "membership",
        "subscription", "cult.fit", "curefit",
    ],
    "Healthcare": [
        "apollo pharmacy", "medplus", "netmeds", "1mg", "pharmeasy", "tata 1mg",
        "pharmacy", "hospital", "fortis", "manipal", "narayana health",
        "columbia asia", "max healthcare", "consultation", "clinic", "dr. ",
        "family clinic", "sharma", "diagnostic", "thyrocare", "lal pathlabs", "dental",
        "dentist", "medical", "health insurance", "star health", "niva bupa",
        "hdfc ergo health",
    ],
    "Entertainment": [
        "pvr", "inox", "cinepolis", "bookmyshow", "district by zomato",
        "paytm insider", "lbb", "concert", "bowling", "escape room", "steam ",
        "playstation", "xbox", "nintendo", "games", "kindle", "audible", "museum",
        "zoo", "aquarium", "spa", "salon", "nykaa salon",
    ],
    "Shopping": [
        "amazon.in", "flipkart", "myntra", "ajio", "meesho", "snapdeal", "nykaa",
        "tata cliq", "reliance digital", "croma", "vijay sales", "ikea india",
        "home centre", "lifestyle stores", "max fashion", "pantaloons", "westside",
        "h&m india", "zara india", "adidas india", "nike india", "puma india",
        "online shopping", "fashion shopping",
    ],
    "Other": [
        "atm withdrawal", "cash withdrawal", "donation", "charity", "ngo",
        "temple donation", "bank charge", "bank fee", "overdraft", "late payment fee",
        "interest charge", "cheque bounce", "neft charges",
    ],
}

# Words of a question that stand for a category (whole words, this category order).
CATEGORY_TRIGGERS = {
    "Rent/Housing": ["rent", "housing", "lease", "emi", "maintenance"],
    "Groceries": ["grocery", "groceries", "supermarket", "kirana", "vegetables",
                  "provision", "provisions"],
    "Subscriptions": ["subscription", "subscriptions", "streaming", "membership", "ott",
                      "netflix", "spotify", "hotstar", "prime video"],
    "Transport": ["transport", "transportation", "travel", "cab", "cabs", "taxi", "uber",
                  "ola", "metro", "bus", "train", "flight", "fuel", "petrol", "diesel",
                  "commute", "fastag", "toll"],
    "Utilities": ["utility", "utilities", "electricity", "bill", "bills", "broadband",
                  "internet", "water bill", "gas bill", "postpaid", "bescom",
                  "power bill"],
    "Healthcare": ["health", "healthcare", "medical", "medicine", "pharmacy", "hospital",
                   "doctor", "clinic", "dental", "diagnostic"],
    "Entertainment": ["entertainment", "movie", "movies", "cinema", "theatre", "theater",
                      "concert", "event", "games", "gaming", "spa", "salon"],
    "Food & Dining": ["food", "dining", "restaurant", "restaurants", "eat", "eating",
                      "dinner", "lunch", "breakfast", "cafe", "coffee", "swiggy",
                      "zomato", "order", "takeaway", "snacks"],
    "Shopping": ["shopping", "shop", "purchase", "purchases", "online order", "amazon",
                 "flipkart", "myntra", "clothes", "apparel", "electronics"],
    "Savings/Transfer": ["savings", "saving", "transfer", "sip", "mutual fund",
                         "investment", "investments"],
    "Income": ["income", "salary", "payroll", "earnings", "credited", "freelance",
               "revenue"],
}

# Merchant names recognized in a question (whole words; the longest one wins).
BRANDS = [
    "swiggy", "zomato", "bigbasket", "dmart", "d-mart", "zepto", "blinkit", "jiomart",
    "grofers", "netflix", "spotify", "hotstar", "amazon prime", "amazon", "flipkart",
    "myntra", "ajio", "meesho", "nykaa", "croma", "uber", "ola", "rapido", "irctc",
    "redbus", "makemytrip", "indigo", "spicejet", "air india", "starbucks",
    "chaos point", "chai point", "cafe coffee day", "ccd", "mcdonald", "kfc", "domino",
    "pizza hut", "subway", "barbeque nation", "pvr", "inox", "bookmyshow", "cult.fit",
    "curefit", "apollo pharmacy", "medplus", "netmeds", "1mg", "pharmeasy", "bescom",
    "tata power", "airtel", "jio", "act fibernet", "hathway", "ikea", "westside",
    "pantaloons", "zara", "adidas", "nike", "puma",
]

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
]

# Month words of a question: full names and these short forms.
MONTH_TOKENS = [
    "january", "jan", "february", "feb", "march", "mar", "april", "apr", "may", "june",
    "jun", "july", "jul", "august", "aug", "september", "sep", "sept", "october", "oct",
    "november", "nov", "december", "dec",
]

# A question that contains one of these (anywhere, also inside a word) asks for a total.
AGGREGATE_WORDS = [
    "total", "sum", "how much", "how many", "count", "average", "avg", "overall",
    "spent", "spend", "spending", "all", "across", "combined", "altogether", "in total",
    "grand total",
]

# A question that contains one of these has no month restriction.
ALL_MONTHS_PHRASES = [
    "all month", "all months", "every month", "each month", "across all",
    "all 3 month", "all three month", "whole year", "entire year", "year to date", "ytd",
]
