"""Fixed values.

Everything in the first block must equal the values the donation-risk model is
defined with (lookup tables, weights, thresholds, category names). They are
stated plainly, in their natural order, and used unchanged by the operators.
The second block holds the values of *our* fixture mapping from the driver's
TPC-H-like tables to bank transactions; they are our own choice.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES of the donation model (must match for equal results)
# ---------------------------------------------------------------------------

# Bank columns that have no meaning for a charity.
BANK_DROP_COLUMNS = [
    "Bank_Branch", "Merchant_ID", "Merchant_Category",
    "Transaction_Description", "Customer_Contact", "Customer_Email",
]

# Bank column -> donation column.
BANK_RENAME = {
    "Customer_ID": "Donor_ID",
    "Customer_Name": "Donor_Name",
    "State": "Donor_Region",
    "City": "Donor_City",
    "Account_Type": "Donor_Segment",
    "Transaction_ID": "Donation_ID",
    "Transaction_Date": "Donation_Date",
    "Transaction_Time": "Donation_Time",
    "Transaction_Amount": "Donation_Amount_INR",
    "Transaction_Type": "Donation_Type_Raw",
    "Account_Balance": "Donor_Lifetime_Value_INR",
    "Transaction_Device": "Device_Raw",
    "Transaction_Location": "Donation_Location",
    "Device_Type": "Device_Category",
    "Is_Fraud": "Is_Fraud",
}

# Source state -> "City, Country"; unmapped states default to London.
REGION_MAP = {
    "Nagaland": "London, UK",
    "Meghalaya": "Manchester, UK",
    "Uttar Pradesh": "Birmingham, UK",
    "Uttarakhand": "Edinburgh, UK",
    "Lakshadweep": "Bristol, UK",
    "Telangana": "Leeds, UK",
    "Haryana": "Glasgow, UK",
    "Delhi": "Liverpool, UK",
    "Maharashtra": "Sheffield, UK",
    "Karnataka": "Cardiff, UK",
    "Gujarat": "New York, US",
    "Rajasthan": "Washington DC, US",
    "Tamil Nadu": "Los Angeles, US",
    "West Bengal": "Chicago, US",
    "Punjab": "Houston, US",
    "Kerala": "San Francisco, US",
    "Andhra Pradesh": "Seattle, US",
    "Madhya Pradesh": "Boston, US",
    "Goa": "Dubai, UAE",
    "Odisha": "Abu Dhabi, UAE",
    "Assam": "Doha, Qatar",
    "Jharkhand": "Kuwait City, Kuwait",
    "Himachal Pradesh": "Riyadh, Saudi Arabia",
    "Chhattisgarh": "Amman, Jordan",
    "Chandigarh": "Berlin, Germany",
    "Manipur": "Paris, France",
    "Tripura": "Amsterdam, Netherlands",
    "Mizoram": "Stockholm, Sweden",
    "Arunachal Pradesh": "Copenhagen, Denmark",
    "Jammu and Kashmir": "Toronto, Canada",
    "Sikkim": "Sydney, Australia",
    "Dadra and Nagar Haveli and Daman and Diu": "Melbourne, Australia",
    "Andaman and Nicobar Islands": "Vancouver, Canada",
}
REGION_DEFAULT = "London, UK"

# Country -> (currency, rate per INR); default GBP.
CURRENCY_BY_COUNTRY = {
    "UK": ("GBP", "0.0095"),
    "US": ("USD", "0.012"),
    "UAE": ("USD", "0.012"),
    "Qatar": ("USD", "0.012"),
    "Kuwait": ("USD", "0.012"),
    "Saudi Arabia": ("USD", "0.012"),
    "Jordan": ("USD", "0.012"),
    "Germany": ("EUR", "0.011"),
    "France": ("EUR", "0.011"),
    "Netherlands": ("EUR", "0.011"),
    "Sweden": ("SEK", "0.125"),
    "Denmark": ("DKK", "0.082"),
    "Canada": ("CAD", "0.016"),
    "Australia": ("AUD", "0.018"),
}
CURRENCY_DEFAULT = ("GBP", "0.0095")

# Currency -> rate per INR (used for lifetime value).
RATE_BY_CURRENCY = {
    "GBP": "0.0095", "USD": "0.012", "EUR": "0.011",
    "SEK": "0.125", "DKK": "0.082", "CAD": "0.016", "AUD": "0.018",
}

SEGMENT_MAP = {
    "Savings": "Individual",
    "Checking": "Individual",
    "Business": "Corporate",
}

DONATION_TYPE_MAP = {
    "Transfer": "Bank Transfer",
    "Bill Payment": "Direct Debit",
    "Debit": "Card",
    "Withdrawal": "Refund",
    "Credit": "Gift",
}

PLATFORM_MAP = {
    "Web Browser": "JustGiving",
    "Mobile Device": "Mobile App",
    "Desktop/Laptop": "Campaign Website",
    "Tablet": "Campaign Website",
    "Debit/Credit Card": "Card (Phone)",
    "Payment Gateway Device": "Stripe Checkout",
    "POS Terminal": "Card (Phone)",
    "POS Mobile Device": "Card (Phone)",
    "POS Mobile App": "Card (Phone)",
    "Smart Card": "Card (Phone)",
    "ATM": "Bank Transfer",
    "ATM Booth Kiosk": "Bank Transfer",
    "Self-service Banking Machine": "Bank Transfer",
    "Bank Branch": "Bank Transfer",
    "Virtual Card": "Virtual Card",
    "QR Code Scanner": "QR Code",
    "Voice Assistant": "Voice Assistant",
    "Banking Chatbot": "Chatbot",
    "Wearable Device": "Wearable",
    "Biometric Scanner": "Biometric",
}
PLATFORM_DEFAULT = "Campaign Website"

PROCESSOR_BY_PLATFORM = {
    "JustGiving": "JustGiving",
    "Mobile App": "Stripe",
    "Campaign Website": "Stripe",
    "Card (Phone)": "WorldPay",
    "Stripe Checkout": "Stripe",
    "Bank Transfer": "GoCardless",
    "Direct Debit": "GoCardless",
    "Virtual Card": "PayPal",
    "QR Code": "PayPal",
    "Voice Assistant": "PayPal",
    "Chatbot": "PayPal",
    "Wearable": "Stripe",
    "Biometric": "Stripe",
}
PROCESSOR_DEFAULT = "Stripe"

# (id, name, weight)
CAMPAIGNS = [
    ("SC-2024-EMG", "Emergency Relief Fund 2024", 0.28),
    ("SC-2024-WIN", "Winter Appeal 2024", 0.18),
    ("SC-2024-EDU", "Education Fund 2024", 0.14),
    ("SC-2024-MED", "Medical Supplies Appeal", 0.12),
    ("SC-2024-REF", "Refugee Support Programme", 0.10),
    ("SC-2023-EMG", "Emergency Relief Fund 2023", 0.08),
    ("SC-2024-RAM", "Ramadan Appeal 2024", 0.06),
    ("SC-2024-MAT", "Matched Giving December", 0.04),
]
EMERGENCY_CAMPAIGN = "SC-2024-EMG"
MATCHED_CAMPAIGN = "SC-2024-MAT"

FREQUENCIES = [("First-time", 0.42), ("Occasional", 0.28), ("Regular", 0.22), ("Lapsed", 0.08)]
RECURRING_PROB = {"Regular": 0.85, "Occasional": 0.20, "First-time": 0.08, "Lapsed": 0.00}

CHANNELS = [
    ("Email", 0.28), ("Social Media", 0.24), ("Direct Mail", 0.14), ("Organic Search", 0.12),
    ("Referral", 0.10), ("Corporate Partnership", 0.06), ("Events", 0.04), ("Cold Outreach", 0.02),
]

TENURE_SCALE = 400
TENURE_MAX = 3650
REGULAR_TENURE = (365, 3650)  # integers in [365, 3650)

ANON_BASE, ANON_HIGHVAL, ANON_PLATFORM = 0.08, 0.15, 0.25
ANON_PLATFORMS = ["Virtual Card", "QR Code", "Chatbot"]
GIFT_AID_UK = 0.72
REFUND_BASE, REFUND_HIGHVAL, REFUND_PLATFORM = 0.02, 0.04, 0.06
REFUND_PLATFORMS = ["Virtual Card", "Chatbot"]
MATCHED_BASE, MATCHED_CORPORATE, MATCHED_DECEMBER = 0.05, 0.18, 0.60
MAJOR_DONOR_DRAW = 0.30

CARD_PLATFORMS = [
    "JustGiving", "Mobile App", "Campaign Website",
    "Card (Phone)", "Stripe Checkout", "Wearable", "Biometric",
]
CVV_PASS = 0.94
DEVICE_BUCKETS = [("Known Clean", 0.78), ("First Seen", 0.97), ("Known Flagged", 1.0)]
WEBHOOK_BUCKETS = [
    ("payment.authorised", 0.91), ("payment.declined", 0.955),
    ("payment.reversed", 0.983), ("chargeback.received", 1.0),
]

# IP mismatch: base + additive terms, capped.
MISMATCH_BASE, MISMATCH_ANON, MISMATCH_PLATFORM, MISMATCH_FIRST, MISMATCH_GULF, MISMATCH_CAP = (
    0.10, 0.08, 0.06, 0.03, 0.05, 0.40)
MISMATCH_PLATFORMS = ["Virtual Card", "QR Code"]
GULF_COUNTRIES = ["UAE", "Qatar", "Kuwait", "Saudi Arabia", "Jordan"]
VPN_BASE, VPN_MISMATCH, VPN_ANON, VPN_PLATFORM, VPN_CAP = 0.06, 0.12, 0.07, 0.05, 0.40
VPN_PLATFORMS = ["Virtual Card", "Chatbot"]
VPN_FORCES_MISMATCH = 0.65

# IP velocity layers (later layer wins).
VELOCITY_REGULAR = (0.08, 2, 4)      # prob, low, high (exclusive)
VELOCITY_CORPORATE = (0.06, 2, 5)
VELOCITY_AMBIENT = (0.04, 2)
VELOCITY_CARD_TESTING = 0.01
VELOCITY_CARD_VALUES = [(3, 0.35), (4, 0.25), (5, 0.18), (8, 0.12), (12, 0.07), (20, 0.03)]

# Rules / features.
TARGET_ANOMALY_RATE = 0.055
NOISE_SD = 0.10
MISS_RATE = 0.12
FALSE_FLAG_RATE = 0.005
STRUCTURING_THRESHOLDS = [500, 750, 900, 950]
NEAR_THRESHOLD_BAND = 0.99
ROUND_MODULUS = 50
HIGH_RISK_PLATFORMS_FEATURE = [
    "Virtual Card", "QR Code", "Voice Assistant", "Chatbot", "Wearable", "Biometric",
]
HIGH_RISK_PLATFORMS_RULE = ["Virtual Card", "QR Code", "Voice Assistant", "Chatbot", "Wearable"]
NIGHT_HOURS = (0, 4)
BUSINESS_HOURS = (9, 17)

CAT_ENCODE = [
    "Gender", "Donor_Country", "Donor_Segment", "Donation_Frequency",
    "Donation_Type", "Donation_Platform", "Payment_Processor",
    "Campaign_ID", "Acquisition_Channel", "Currency",
    "CVV_Check", "Device_Fingerprint", "Webhook_Event",
]

NUMERIC_FEATURES = [
    "Age", "Donor_Since_Days", "Log_Donor_Lifetime_Value", "Is_Recurring",
    "Is_Anonymous", "Matched_Giving", "Gift_Aid_Eligible",
    "Log_Donation_Amount", "Donation_Amount_Zscore", "Amt_LTV_Ratio",
    "Hour", "Is_Night_Donation", "Is_Weekend", "Is_Business_Hours",
    "Is_Round_Amount", "Near_Threshold",
    "High_Risk_Platform", "Is_Cold_Acquisition",
    "Is_Bank_Transfer", "Is_Refund_Type",
    "CVV_Failed", "Device_Flagged", "Webhook_Chargeback", "Webhook_Reversed",
    "Refund_Requested", "Is_First_Time_Large", "Is_Anon_Large",
    "Is_Corporate_Night", "Matched_Anon_Flag",
    "IP_Country_Match", "Is_VPN_Or_Proxy", "IP_Velocity_24h",
    "IP_Mismatch_Large", "VPN_Anon_Flag", "High_Velocity_Flag",
]
MODEL_FEATURES = NUMERIC_FEATURES + CAT_ENCODE

DONATION_COLUMNS = [
    "Donor_ID", "Donor_Name", "Gender", "Age",
    "Donor_City", "Donor_Country", "Donor_Segment",
    "Donor_Since_Days", "Donor_Lifetime_Value",
    "Donation_Frequency", "Acquisition_Channel",
    "Donation_ID", "Donation_Date", "Donation_Time",
    "Donation_Amount", "Currency",
    "Donation_Type", "Donation_Platform", "Payment_Processor",
    "Campaign_ID", "Campaign_Name",
    "Is_Recurring", "Is_Anonymous", "Matched_Giving",
    "Gift_Aid_Eligible", "Refund_Requested",
    "CVV_Check", "Device_Fingerprint", "Webhook_Event",
    "IP_Country_Match", "Is_VPN_Or_Proxy", "IP_Velocity_24h",
]

# Risk tiers: lower bound (inclusive) -> name.
TIERS = [("Low", 0.0), ("Medium", 0.30), ("High", 0.60), ("Critical", 0.80)]
TIER_ORDER = ["Critical", "High", "Medium", "Low"]
TIER_ACTIONS = {
    "Critical": "Block and escalate to senior compliance officer immediately.",
    "High": "Queue for compliance review within 24 hours.",
    "Medium": "Monitor donor activity; review if pattern repeats.",
    "Low": "No action required. Log and continue.",
}

# Partner-signal boost of the single-donation scorer.
BOOST_CVV_FAIL = 0.25
BOOST_DEVICE = {"Known Flagged": 0.30, "First Seen": 0.05}
BOOST_WEBHOOK = {"payment.reversed": 0.20, "chargeback.received": 0.35, "payment.declined": 0.10}
EXPLAIN_RATIO = 3.5

# Sanctions screening.
DEFAULT_MIN_MATCH = 0.75
SCREEN_LIMIT = 10
REMARKS_MAX = 300
# payload key -> (list name, default entity type)
SANCTIONS_LISTS = {
    "SDNs": ("SDN", "individual"),
    "altNames": ("SDN", "individual"),
    "deniedPersons": ("DPL", "individual"),
    "bisEntities": ("BIS", "organization"),
    "euConsolidatedSanctionsList": ("EU-CSL", "individual"),
    "ukConsolidatedSanctionsList": ("UK-CSL", "individual"),
    "sectoralSanctions": ("SSI", "organization"),
}
DEMO_SDN_NAMES = [
    "Nicolas Maduro",
    "Kim Jong Un",
    "Bashar al-Assad",
    "Viktor Bout",
    "Semion Mogilevich",
]
DEMO_HIT = {
    "entity_id": "DEMO-SDN-001", "match_score": 0.98, "list_name": "SDN (DEMO)",
    "entity_type": "individual", "programs": ["SYRIA", "IRAN"],
}
SCREEN_ACTIONS = {
    "BLOCKED": "Hard block — escalate + file SAR",
    "OFFLINE": "Manual review required",
    "CLEAR": "Clear to process",
    "UNREADABLE": "Manual review required",
}

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# ---------------------------------------------------------------------------
# Our fixture mapping (driver tables -> bank transactions); our own values
# ---------------------------------------------------------------------------

# n_nationkey -> source state; keys 23 and 24 map to states outside REGION_MAP
# so that the London default is exercised.
NATION_STATE = [
    "Nagaland", "Meghalaya", "Uttar Pradesh", "Telangana",        # UK
    "Gujarat", "Rajasthan", "Tamil Nadu", "Kerala",               # US
    "Goa", "Odisha", "Assam", "Jharkhand", "Himachal Pradesh",    # Gulf
    "Chhattisgarh", "Chandigarh", "Manipur", "Tripura",           # Jordan, EU
    "Mizoram", "Arunachal Pradesh", "Jammu and Kashmir",          # SE, DK, CA
    "Andaman and Nicobar Islands", "Sikkim",                      # CA, AU
    "Dadra and Nagar Haveli and Daman and Diu",                   # AU
    "Bihar", "Ladakh",                                            # unmapped
]

# FIXED VALUES: sizes of the models
FOREST_TREES, FOREST_DEPTH, FOREST_MIN_LEAF = 300, 16, 4
CV_TREES, CV_DEPTH, CV_MIN_LEAF = 100, 12, 1  # the forest of the cross-validation
LOGISTIC_ITERATIONS = 1000
ISOLATION_TREES, ISOLATION_ROWS, CONTAMINATION = 200, 256, 0.055
CALIBRATION_FOLDS = 5

# Our fixture: names in other scripts, accented names and demo-list names; a twentieth
# of the donors (and of the listed people) bear one.
WORLD_NAME_SHARE = 0.05
WORLD_NAMES = [
    "Иван Петров", "Мария Иванова", "محمد علي", "علي حسن", "Zoë Müller", "José Núñez", "Łukasz Żak",
    "Kim Jong Un", "Nicolas Maduro", "李小龙 王", "12345",
]
FIRST_NAMES = [
    "Amira", "Ben", "Chloe", "Daniel", "Elena", "Farid", "Grace", "Hassan", "Isla", "Jonas",
    "Karim", "Lena", "Marco", "Nadia", "Oscar", "Priya", "Rami", "Sofia", "Tomas", "Yara",
]
LAST_NAMES = [
    "Abbott", "Bennett", "Costa", "Duarte", "Eriksen", "Fischer", "Haddad", "Ibrahim", "Jensen",
    "Khalil", "Larsen", "Moreau", "Nasser", "Okafor", "Petrov", "Quinn", "Rossi", "Saleh",
    "Tanaka", "Weber",
]

PRIORITY_TO_TYPE = {
    "1-URGENT": "Transfer",
    "2-HIGH": "Bill Payment",
    "3-MEDIUM": "Debit",
    "4-NOT SPECIFIED": "Withdrawal",
    "5-LOW": "Credit",
}
MKTSEGMENT_TO_ACCOUNT = {
    "AUTOMOBILE": "Savings",
    "BUILDING": "Savings",
    "FURNITURE": "Checking",
    "HOUSEHOLD": "Checking",
    "MACHINERY": "Business",
}
BANK_DEVICES = list(PLATFORM_MAP)  # 20 raw device names
ROUND_AMOUNT_SHARE = 0.05
ROUND_AMOUNT = 5000

# payment events from the driver's events table
EVENT_TO_WEBHOOK = {
    "purchase": "payment.authorised",
    "error": "payment.declined",
    "view": "payment.reversed",
    "signup": "chargeback.received",
    "click": "donation.attempt",
}
