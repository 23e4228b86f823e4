"""Small reference tables.

Every table in this module is a set of fixed values: results are only right
when these agree with the published rules, so they are stated plainly.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

def frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """Frame of a fixed table; Spark knows its size and broadcasts it by that."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# ---------------------------------------------------------------- fixed values
# Spellings of state names (lower case, trimmed) to the canonical name.
STATE_SPELLINGS = {
    "andaman and nicobar islands": "Andaman and Nicobar Islands",
    "andhra pradesh": "Andhra Pradesh",
    "arunachal pradesh": "Arunachal Pradesh",
    "assam": "Assam",
    "bihar": "Bihar",
    "chandigarh": "Chandigarh",
    "chhattisgarh": "Chhattisgarh",
    "chattisgarh": "Chhattisgarh",
    "dadra and nagar haveli": "Dadra and Nagar Haveli",
    "dadra & nagar haveli": "Dadra and Nagar Haveli",
    "daman and diu": "Daman and Diu",
    "delhi": "Delhi",
    "nct of delhi": "Delhi",
    "goa": "Goa",
    "gujarat": "Gujarat",
    "haryana": "Haryana",
    "himachal pradesh": "Himachal Pradesh",
    "jammu and kashmir": "Jammu and Kashmir",
    "jharkhand": "Jharkhand",
    "karnataka": "Karnataka",
    "kerala": "Kerala",
    "lakshadweep": "Lakshadweep",
    "madhya pradesh": "Madhya Pradesh",
    "maharashtra": "Maharashtra",
    "manipur": "Manipur",
    "meghalaya": "Meghalaya",
    "mizoram": "Mizoram",
    "nagaland": "Nagaland",
    "odisha": "Odisha",
    "orissa": "Odisha",
    "puducherry": "Puducherry",
    "pondicherry": "Puducherry",
    "punjab": "Punjab",
    "rajasthan": "Rajasthan",
    "sikkim": "Sikkim",
    "tamil nadu": "Tamil Nadu",
    "telangana": "Telangana",
    "tripura": "Tripura",
    "uttar pradesh": "Uttar Pradesh",
    "uttarakhand": "Uttarakhand",
    "uttrakhand": "Uttarakhand",
    "west bengal": "West Bengal",
}

# Commodity text to crop, exact after trim and lower (incremental quotes).
COMMODITY_CROPS = {
    "wheat": "wheat",
    "paddy(dhan)(common)": "rice",
    "paddy (dhan)(common)": "rice",
    "paddy(dhan)(a-grade)": "rice",
    "paddy (dhan)(a-grade)": "rice",
    "paddy(dhan)(grade a)": "rice",
    "paddy (dhan)(grade a)": "rice",
    "paddy(common)": "rice",
    "paddy (common)": "rice",
    "rice": "rice",
    "maize": "maize",
    "potato": "potato",
    "onion": "onion",
}

# Commodity fragments for the yearly archive: the first one contained wins.
COMMODITY_FRAGMENTS = [
    ("wheat", "wheat"),
    ("paddy(dhan)(common)", "rice"),
    ("paddy (dhan)(common)", "rice"),
    ("paddy(dhan)(a-grade)", "rice"),
    ("paddy (dhan)(a-grade)", "rice"),
    ("paddy(dhan)(grade a)", "rice"),
    ("paddy (dhan)(grade a)", "rice"),
    ("paddy(common)", "rice"),
    ("paddy (common)", "rice"),
    ("maize", "maize"),
    ("potato", "potato"),
    ("onion", "onion"),
]

PRICE_CROPS = ["rice", "wheat", "maize", "onion", "potato"]
HIGH_UNCERTAINTY_CROPS = ["onion", "potato"]

# Modal price bounds, rupees per quintal.
MODAL_BOUNDS = (100.0, 45000.0)

# Season names and months.
SEASON_ALIASES = {
    "rainy": "Kharif",
    "rainy season": "Kharif",
    "monsoon": "Kharif",
    "kharif": "Kharif",
    "winter": "Rabi",
    "winter season": "Rabi",
    "rabi": "Rabi",
    "summer": "Summer",
    "summer season": "Summer",
    "zaid": "Summer",
    "whole year": "Whole Year",
    "all year": "Whole Year",
    "perennial": "Whole Year",
}
SEASON_MONTHS = {
    "Kharif": [6, 7, 8, 9, 10],
    "Rabi": [11, 12, 1, 2, 3],
    "Zaid": [4, 5],
    "Summer": [4, 5],
    "Whole Year": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],
}
SEASON_CODES = {"Kharif": 0, "Rabi": 1, "Zaid": 2}

# Date formats, tried in order.
ARCHIVE_DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy"]
QUOTE_DATE_FORMATS = ["dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy"]
OBSERVATION_DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]

# Age ladders: (largest age that still earns the label), then the last label.
FRESHNESS_LADDERS = {
    "market": ([(3, "VERY_FRESH"), (14, "FRESH"), (30, "RECENT"), (60, "BACKGROUND"), (180, "STALE")], "VERY_STALE"),
    "news": ([(3, "VERY_FRESH"), (14, "FRESH"), (30, "RECENT")], "STALE"),
    "quote": ([(3, "Fresh"), (7, "Recent")], "Historical"),
    "signal": ([(14, "FRESH"), (60, "RECENT")], "STALE"),
}

# Disruption calendars, closed intervals; "registry" says which list a row is from.
DISRUPTIONS = [
    ("feature", "COVID-19 Pandemic", "2020-03-01", "2020-12-31", 1.0),
    ("feature", "Russia-Ukraine War", "2022-02-24", "2022-12-31", 1.0),
    ("feature", "Post-War Inflation Tail", "2023-01-01", "2023-06-30", 1.0),
    ("decision", "2019 Drought", "2019-06-01", "2019-09-30", 1.1),
    ("decision", "COVID-19 Lockdown & Supply Chain Disruption", "2020-03-15", "2021-12-31", 1.15),
    ("decision", "Russia-Ukraine War & Global Fertilizer Price Surge", "2022-02-24", "2023-12-31", 1.12),
]

# Futures contracts: unit and kilograms in the unit's divisor.
FUTURES_UNITS = {
    "wheat": ("cents_bushel", 27.2155),
    "rice": ("usd_cwt", 0.453592),
    "maize": ("cents_bushel", 25.4012),
    "soybean": ("cents_bushel", 27.2155),
}
FUTURES_STATE_FACTORS = {
    "punjab": 0.95, "haryana": 0.95, "maharashtra": 1.08,
    "karnataka": 1.08, "west bengal": 1.05, "uttar pradesh": 0.98,
}
SUPPORT_PRICES = {
    "wheat": 2275, "rice": 2300, "maize": 2090, "cotton": 7121, "soybean": 4892,
    "mustard": 5650, "groundnut": 6783, "potato": 1200, "onion": 1800, "tomato": 1500,
}
SUPPORT_DEFAULT = 2200
SUPPORT_FLOOR = 500
SUPPORT_STATE_FACTORS = {
    "punjab": 0.95, "haryana": 0.95, "maharashtra": 1.10,
    "karnataka": 1.08, "uttar pradesh": 0.98, "west bengal": 1.03,
}

# News: event class keywords in priority order.
EVENT_KEYWORDS = {
    "FLOOD": ["flood", "flooding", "waterlogged", "inundated", "submerged", "dam overflow"],
    "DROUGHT": ["drought", "dry spell", "water scarcity", "monsoon deficit", "rain deficit"],
    "HEAVY_RAIN": ["heavy rainfall", "torrential rain", "excess rain", "cloudburst", "downpour"],
    "HEATWAVE": ["heatwave", "scorching heat", "temperature surge", "extreme temperature"],
    "PEST_OUTBREAK": ["locust", "fall armyworm", "bollworm", "pest attack", "pest infestation", "stem borer"],
    "DISEASE_OUTBREAK": ["blast disease", "rust disease", "blight", "mosaic virus", "fungal disease", "rot"],
    "CROP_DAMAGE": ["crop damage", "crop loss", "yield loss", "hailstorm damage", "standing crop damaged"],
    "EXPORT_RESTRICTION": ["export ban", "export curb", "minimum export price", "export duty", "mep", "export prohibited"],
    "IMPORT_RESTRICTION": ["import duty", "import tariff", "import relaxed", "duty-free import"],
    "MSP_POLICY": ["msp", "minimum support price", "procurement price", "cpc procurement", "cabinet approves msp"],
    "FERTILIZER": ["fertilizer subsidy", "urea shortage", "dap shortage", "npk subsidy", "fertilizer price"],
    "FUEL_PRICE": ["diesel price", "fuel subsidy", "pump price", "tractor fuel"],
    "SUPPLY_SHOCK": ["supply disruption", "mandi arrival halted", "transport strike", "supply crisis"],
    "DEMAND_SHOCK": ["festive demand", "bulk purchase", "offseason demand", "consumption rise"],
    "TRADE_POLICY": ["tariff", "customs duty", "quota", "trade agreement"],
    "CYCLONE": ["cyclone", "cyclonic storm", "depression in bay", "landfall"],
    "COLD_WAVE": ["cold wave", "frost", "ground frost", "winter freeze"],
    "MARKET_PRICE_EVENT": ["price crash", "price surge", "mandi rate drops", "record high price", "price spiked"],
}

# News: names looked for in text, in priority order.
NEWS_STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa",
    "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland",
    "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura",
    "Uttar Pradesh", "Uttarakhand", "West Bengal",
]
NEWS_CROPS = [
    "Rice", "Wheat", "Maize", "Onion", "Potato", "Sugarcane", "Cotton", "Soybean",
    "Chickpea", "Groundnut", "Mustard", "Barley", "Jowar", "Bajra", "Ragi", "Urad",
    "Moong", "Tur", "Arecanut", "Coconut", "Banana", "Black Pepper", "Cardamom",
    "Ginger", "Turmeric", "Tea", "Coffee", "Tobacco", "Jute", "Cashew",
]

# News: credibility weight of the registry tiers.
TIER_WEIGHTS = {"TIER_1": 1.0, "TIER_2": 0.8, "TIER_3": 0.6}
TIER_WEIGHT_DEFAULT = 0.4

# News: source-name fragments per credibility tier, in priority order.
SOURCE_TIERS = [
    ("TIER_1_OFFICIAL", 1.0, [
        "icar", "pib", "department of agriculture", "ministry of agriculture", "imd",
        "ministry of earth sciences", "kvk", "apmc", "state agriculture department",
        "state horticulture department", "disaster management authority", "agricultural university"]),
    ("TIER_2_AGRI_RESEARCH", 0.8, [
        "krishi jagran", "rural voice", "agrospectrum", "agriwatch", "krishak jagat",
        "agriculture world", "fao", "down to earth"]),
    ("TIER_3_BUSINESS_MARKET", 0.6, [
        "reuters", "economic times", "business standard", "financial express",
        "businessline", "moneycontrol", "bloomberg"]),
    ("TIER_4_GENERAL_MEDIA", 0.4, [
        "the hindu", "indian express", "times of india", "hindustan times",
        "deccan herald", "tribune", "matrubhumi", "dinakaran", "lokmat"]),
]
DISCOVERY_TIER = ("DISCOVERY_ONLY", 0.2, ["google", "feed"])
DEFAULT_TIER = ("TIER_4_GENERAL_MEDIA", 0.4)

# News: signal vocabulary by sign, used for conflict and adjustment.
BAD_SIGNALS = ["RISK_INCREASED", "HIGH_RISK", "NEGATIVE"]
RAISED_SIGNALS = ["RISK_ELEVATED", "MODERATE_RISK"]
GOOD_SIGNALS = ["RISK_DECREASED", "POSITIVE", "FAVORABLE"]

# Place-name rewrites, applied in order after accents are removed.
PLACE_REWRITES = [
    ("dakshina", "dakshin"), ("uttara", "uttar"), ("kannada", "kannad"), ("east", "purbi"),
    ("purba", "purbi"), ("west", "pashchim"), ("paschim", "pashchim"), ("south", "dakshin"),
    ("north", "uttar"), ("visakhapatnam", "visakhapatanam"), ("district", ""),
    ("metropolitan", ""), ("ut", ""), ("nct", ""),
]
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"

# Districts that were renamed: canonical name, state, known spellings.
DISTRICT_ALIASES = [
    ("Ahilya Nagar", "Maharashtra", ["ahmednagar", "ahmed nagar", "ahmednagar district", "ahilyanagar",
                                     "ahilya nagar", "ahmadnagar", "ahmad nagar", "ahilyanagar district"]),
    ("Chhatrapati Sambhajinagar", "Maharashtra", ["aurangabad", "aurangabad district",
                                                  "chhatrapati sambhaji nagar", "chhatrapati sambhajinagar",
                                                  "sambhajinagar", "aurangabad (maharashtra)"]),
    ("Dharashiv", "Maharashtra", ["osmanabad", "osmanabad district", "dharashiv", "dharashiv district"]),
    ("Dakshina Kannada", "Karnataka", ["dakshina kannada", "dakshin kannad", "south kanara",
                                       "dakshina kannada (mangalore)", "mangalore district"]),
    ("Uttara Kannada", "Karnataka", ["uttara kannada", "uttar kannad", "north kanara",
                                     "uttara kannada (karwar)", "karwar district"]),
    ("Mysuru", "Karnataka", ["mysore", "mysuru", "mysore district", "mysuru district"]),
    ("Ballari", "Karnataka", ["bellary", "ballari", "bellary district", "ballari district"]),
    ("Belagavi", "Karnataka", ["belgaum", "belagavi", "belgaum district", "belagavi district"]),
    ("Kalaburagi", "Karnataka", ["gulbarga", "kalaburagi", "gulbarga district", "kalaburagi district"]),
    ("Shivamogga", "Karnataka", ["shimoga", "shivamogga", "shimoga district", "shivamogga district"]),
    ("Vijayapura", "Karnataka", ["bijapur", "vijayapura", "bijapur district", "vijayapura district"]),
    ("Prayagraj", "Uttar Pradesh", ["allahabad", "prayagraj", "allahabad district", "prayagraj district"]),
    ("Ayodhya", "Uttar Pradesh", ["faizabad", "ayodhya", "faizabad district", "ayodhya district"]),
    ("Purba Bardhaman", "West Bengal", ["burdwan", "bardhaman", "barddhaman", "purba bardhaman", "burdwan district"]),
]

# Crop groups for rotation and season rules.
PERENNIAL_CROPS = ["Arecanut", "Coconut", "Coffee", "Tea", "Rubber", "Banana", "Black Pepper",
                   "Cardamom", "Cashew", "Sugarcane"]
LEGUME_CROPS = ["Moong (Green Gram)", "Black Gram (Urad)", "Pigeonpea (Arhar/Tur)", "Chickpea (Gram)",
                "Lentil (Masur)", "Groundnut", "Soybean"]
CROP_FAMILIES = {
    "Rice": "Poaceae", "Wheat": "Poaceae", "Maize": "Poaceae", "Sorghum": "Poaceae",
    "Pearl Millet (Bajra)": "Poaceae", "Finger Millet (Ragi)": "Poaceae", "Sugarcane": "Poaceae",
    "Pigeonpea (Arhar/Tur)": "Fabaceae", "Moong (Green Gram)": "Fabaceae", "Black Gram (Urad)": "Fabaceae",
    "Chickpea (Gram)": "Fabaceae", "Lentil (Masur)": "Fabaceae", "Groundnut": "Fabaceae", "Soybean": "Fabaceae",
    "Potato": "Solanaceae", "Tomato": "Solanaceae", "Brinjal": "Solanaceae", "Chilli": "Solanaceae",
    "Onion": "Amaryllidaceae", "Garlic": "Amaryllidaceae",
    "Cotton": "Malvaceae", "Arecanut": "Arecaceae", "Coconut": "Arecaceae",
}

# Seasons in which a model label is grown; labels not listed grow in all three.
CROP_SEASONS = {
    "rice": ["Kharif"], "wheat": ["Rabi"], "maize": ["Kharif", "Rabi"], "cotton": ["Kharif"],
    "sugarcane": ["Kharif", "Rabi", "Zaid"], "groundnut": ["Kharif", "Rabi"], "soybean": ["Kharif"],
    "mustard": ["Rabi"], "chickpea": ["Rabi"], "lentil": ["Rabi"], "mungbean": ["Kharif", "Zaid"],
    "blackgram": ["Kharif"], "pigeonpeas": ["Kharif"], "kidneybeans": ["Rabi"], "mothbeans": ["Kharif"],
    "coconut": ["Kharif", "Rabi", "Zaid"], "banana": ["Kharif", "Rabi", "Zaid"], "mango": ["Kharif", "Rabi", "Zaid"],
    "coffee": ["Kharif", "Rabi", "Zaid"], "jute": ["Kharif"], "apple": ["Rabi"], "grapes": ["Rabi"],
    "orange": ["Rabi"], "papaya": ["Kharif", "Rabi", "Zaid"], "pomegranate": ["Kharif", "Rabi"],
    "watermelon": ["Zaid"], "muskmelon": ["Zaid"], "onion": ["Rabi", "Kharif"], "potato": ["Rabi"],
}

# Market crop name (lower case) to model label.
CROP_LABELS = {
    "paddy (dhan)(common)": "rice", "rice": "rice", "rice (paddy - husked)": "rice", "maize": "maize",
    "wheat": "wheat", "bengal gram (gram)(whole)": "chickpea", "chickpea": "chickpea",
    "arhar (tur/red gram)(whole)": "pigeonpeas", "red gram": "pigeonpeas",
    "green gram (moong)(whole)": "mungbean", "moong": "mungbean",
    "black gram (urd beans)(whole)": "blackgram", "urad": "blackgram", "masoor": "lentil", "lentil": "lentil",
    "rajma": "kidneybeans", "kidney beans": "kidneybeans", "moth": "mothbeans", "moth beans": "mothbeans",
    "banana": "banana", "mango": "mango", "mango (raw-loss green)": "mango", "pomegranate": "pomegranate",
    "grapes": "grapes", "apple": "apple", "orange": "orange", "papaya": "papaya", "papaya (raw)": "papaya",
    "water melon": "watermelon", "watermelon": "watermelon", "musk melon": "muskmelon", "muskmelon": "muskmelon",
    "cotton": "cotton", "cotton (kapas)": "cotton", "raw cotton": "cotton", "coconut": "coconut",
    "coconut seed": "coconut", "jute": "jute", "raw jute": "jute", "coffee": "coffee",
    "groundnut": "groundnut", "soyabean": "soybean", "soybean": "soybean", "onion": "onion", "potato": "potato",
}

# Soil type to nitrogen, phosphorus, potassium and pH.
SOIL_VALUES = {
    "Alluvial Soil": (80, 45, 50, 6.8), "Black Soil": (55, 30, 65, 7.8), "Red Soil": (40, 25, 35, 6.2),
    "Laterite Soil": (35, 20, 30, 5.5), "Desert Soil": (20, 15, 25, 8.2), "Mountain Soil": (60, 35, 40, 5.8),
    "Coastal Alluvial Soil": (70, 40, 55, 7.2), "Sandy Soil": (25, 18, 20, 7.0),
}
SOIL_FALLBACK = (50, 30, 40, 6.5)

# Ideal temperature and rain by group of model labels, then the default pair.
WEATHER_IDEALS = [
    (["rice", "jute", "coconut"], 28.0, 200.0),
    (["wheat", "apple", "grapes", "barley"], 18.0, 75.0),
    (["watermelon", "muskmelon"], 30.0, 50.0),
]
WEATHER_IDEAL_DEFAULT = (25.0, 120.0)

# Climate zone by place-name fragment; places first, then states.
ZONE_PLACES = {
    "leh": "himalayan", "shimla": "himalayan", "kullu": "himalayan", "lahaul": "himalayan", "spiti": "himalayan",
    "dehradun": "himalayan", "nainital": "himalayan", "arunachal": "himalayan", "sikkim": "himalayan",
    "darjeeling": "himalayan", "kolkata": "humid_subtropical", "nadia": "humid_subtropical",
    "murshidabad": "humid_subtropical", "patna": "humid_subtropical", "bhagalpur": "humid_subtropical",
    "lucknow": "sub_humid", "kanpur": "sub_humid", "varanasi": "sub_humid", "agra": "sub_humid",
    "allahabad": "sub_humid", "prayagraj": "sub_humid", "chandigarh": "sub_humid", "ludhiana": "sub_humid",
    "amritsar": "sub_humid", "jaipur": "semi_arid", "jodhpur": "arid", "bikaner": "arid", "jaisalmer": "arid",
    "barmer": "arid", "nagpur": "semi_arid", "bhopal": "semi_arid", "indore": "semi_arid", "raipur": "semi_arid",
    "bundelkhand": "semi_arid", "gwalior": "semi_arid", "sagar": "semi_arid", "pune": "semi_arid",
    "nashik": "semi_arid", "aurangabad": "semi_arid", "solapur": "arid", "bangalore": "semi_arid",
    "bengaluru": "semi_arid", "mysore": "semi_arid", "bijapur": "arid", "gulbarga": "arid", "bellary": "semi_arid",
    "hyderabad": "semi_arid", "visakhapatnam": "humid_tropical", "east godavari": "humid_tropical",
    "west godavari": "humid_tropical", "krishna": "humid_tropical", "guntur": "humid_tropical",
    "nellore": "humid_tropical", "thiruvananthapuram": "humid_tropical", "kozhikode": "humid_tropical",
    "ernakulam": "humid_tropical", "udupi": "humid_tropical", "dakshina kannada": "humid_tropical",
    "north goa": "humid_tropical", "ahmedabad": "semi_arid", "surat": "semi_arid", "vadodara": "semi_arid",
    "rajkot": "arid", "kutch": "arid", "chennai": "semi_arid", "coimbatore": "semi_arid", "madurai": "semi_arid",
    "thanjavur": "humid_tropical", "tiruchirapalli": "semi_arid",
}
ZONE_STATES = {
    "jammu": "himalayan", "kashmir": "himalayan", "himachal": "himalayan", "uttarakhand": "himalayan",
    "west bengal": "humid_subtropical", "uttar pradesh": "sub_humid", "bihar": "sub_humid", "punjab": "sub_humid",
    "haryana": "sub_humid", "delhi": "sub_humid", "madhya pradesh": "semi_arid", "chhattisgarh": "semi_arid",
    "maharashtra": "semi_arid", "karnataka": "semi_arid", "andhra pradesh": "semi_arid", "telangana": "semi_arid",
    "kerala": "humid_tropical", "goa": "humid_tropical", "gujarat": "semi_arid", "rajasthan": "arid",
    "tamil nadu": "semi_arid", "assam": "humid_subtropical", "meghalaya": "humid_subtropical",
    "manipur": "humid_subtropical", "mizoram": "humid_subtropical", "nagaland": "humid_subtropical",
    "tripura": "humid_subtropical", "odisha": "sub_humid", "jharkhand": "sub_humid",
}
ZONE_ALLOWED = {
    "arid": ["bajra", "bajra (pearl millet)", "jowar", "millets", "millets (ragi/jowar)", "groundnut", "mustard",
             "castor", "guar", "moth bean", "cluster bean", "sesame", "sunflower", "cotton", "date palm"],
    "semi_arid": ["cotton", "groundnut", "sorghum", "bajra", "maize", "soybean", "sunflower", "wheat", "jowar",
                  "toor dal", "chickpea", "lentil", "mustard", "onion", "tomato", "millets (ragi/jowar)",
                  "bajra (pearl millet)", "sugarcane"],
    "sub_humid": ["wheat", "rice", "maize", "sugarcane", "potato", "mustard", "soybean", "lentil", "chickpea",
                  "banana", "mango", "cotton", "onion", "garlic"],
    "humid_subtropical": ["rice", "jute", "tea", "sugarcane", "banana", "potato", "maize", "mustard", "lentil",
                          "ginger", "turmeric"],
    "humid_tropical": ["rice", "coconut", "banana", "rubber", "arecanut", "black pepper", "cardamom", "ginger",
                       "turmeric", "cashew", "tapioca (cassava)", "betel leaf", "sugarcane",
                       "paddy (coastal/kharif)", "mango", "coffee", "tea"],
    "himalayan": ["wheat", "potato", "apple", "barley", "buckwheat", "maize", "ginger", "cardamom", "tea"],
}
ZONE_BLOCKED = {
    "arid": ["rice", "sugarcane", "jute", "rubber", "tea", "coconut", "cardamom", "ginger", "banana", "arecanut",
             "black pepper", "tapioca", "betel leaf"],
    "semi_arid": ["rubber", "tea", "jute", "coconut", "arecanut", "cardamom", "tapioca", "black pepper"],
    "sub_humid": ["rubber", "tea", "cardamom", "coconut", "arecanut"],
    "humid_subtropical": ["rubber", "coconut"],
    "humid_tropical": ["wheat", "bajra (pearl millet)"],
    "himalayan": ["cotton", "sugarcane", "rice", "coconut", "rubber", "arecanut", "tapioca (cassava)",
                  "bajra (pearl millet)", "jute"],
}
WATER_INTENSIVE_CROPS = ["rice", "sugarcane", "banana", "jute", "coconut", "rubber", "tea",
                         "paddy (coastal/kharif)", "ginger", "turmeric"]

# Tolerance scoring groups and season priority lists.
COASTAL_CROPS = ["Coconut", "Banana", "Cashew", "Arecanut", "Rubber", "Black Pepper", "Tapioca (Cassava)",
                 "Paddy (Coastal/Kharif)", "Betel Leaf", "Jute", "Cardamom", "Ginger", "Tea"]
HUMID_CROPS = ["Coconut", "Banana", "Rice", "Arecanut", "Black Pepper", "Rubber", "Tea", "Cardamom", "Ginger", "Jute"]
SEASON_PRIORITY = {
    "Kharif": ["Rice", "Paddy (Dhan)(Common)", "Maize", "Cotton", "Soyabean", "Groundnut",
               "Bajra (Pearl Millet/Cumbu)", "Arhar (Tur/Red Gram)(Whole)", "Sugarcane", "Jute", "Sunflower",
               "Ginger", "Turmeric"],
    "Rabi": ["Wheat", "Mustard", "Bengal Gram (Gram)(Whole)", "Chickpea", "Lentil", "Barley", "Sunflower",
             "Peas (Dry)", "Linseed", "Maize"],
    "Zaid": ["Maize", "Groundnut", "Sunflower", "Green Gram (Moong)(Whole)", "Cowpea",
             "Bajra (Pearl Millet/Cumbu)", "Watermelon"],
}
MARKET_VEGETABLES = [
    "tomato", "onion", "potato", "brinjal", "bhindi (ladies finger)",
    "cabbage", "cauliflower", "bottle gourd", "bitter gourd", "ridge gourd",
    "snake gourd", "snakeguard", "ash gourd", "ashgourd", "pumpkin",
    "cucumber", "carrot", "radish", "raddish", "spinach", "coriander",
    "methi (fenugreek)", "green chilli", "capsicum", "garlic", "drumstick",
    "cluster beans", "french beans", "peas (fresh)", "green peas",
    "onion green", "amaranthus", "cowpea (veg)", "banana - green",
    "coriander (leaves)", "mint (pudina)", "curry leaves", "fenugreek leaves",
    "palak", "methi", "beans", "green avare (w)", "chow chow", "beetroot", "turnip",
    "parwal (pointed gourd)", "tinda", "yam", "colocasia", "elephant yam",
    "raw banana", "lemon", "lime",
]
FIELD_CROPS = [
    "rice", "paddy (dhan)(common)", "paddy (coastal/kharif)", "wheat", "maize",
    "bajra (pearl millet/cumbu)", "jowar", "ragi", "millets (ragi/jowar)",
    "sorghum", "barley", "soyabean", "soybean", "groundnut", "mustard",
    "sunflower", "sesame", "linseed", "safflower", "cotton",
    "arhar (tur/red gram)(whole)", "bengal gram (gram)(whole)", "chickpea",
    "green gram (moong)(whole)", "black gram (urd beans)(whole)", "lentil",
    "sugarcane", "jute", "ginger", "turmeric", "cardamom",
    "black pepper", "coffee", "tea", "rubber", "coconut", "arecanut",
    "banana", "mango", "cashew nut",
    "cummin seed (jeera)", "ajwain", "coriander seed", "fennel",
]

# Crop name to the label of the probability model (one published proxy label is
# left unmapped on purpose: it named a different legume).
CANDIDATE_LABELS = {
    "Rice": "rice", "Maize": "maize", "Chickpea (Gram)": "chickpea", "Moong (Green Gram)": "mungbean",
    "Black Gram (Urad)": "blackgram", "Pigeonpea (Arhar/Tur)": "pigeonpeas", "Lentil (Masoor)": "lentil",
    "Cotton": "cotton", "Jute": "jute", "Banana": "banana", "Coconut": "coconut", "Coffee": "coffee",
}

# Rotation multipliers and geographic weights (parameter tables).
ROTATION_FACTORS = [
    ("monoculture_repetition_penalty", 0.35), ("same_family_repetition_penalty", 0.60),
    ("legume_rotation_bonus", 1.25), ("deep_root_rotation_bonus", 1.15),
    ("short_duration_window_bonus", 1.10), ("exceed_duration_window_penalty", 0.20),
]
GEOGRAPHIC_WEIGHTS = [("district", 1.0), ("state", 0.8), ("national", 0.5)]

# Words and patterns that must not reach a public text.
FORBIDDEN_TEXT = [r"[0-9]+(\.[0-9]+)?/[0-9]+", "MAE", "RMSE", "STATE_CROP", "CROP_ONLY", "STATE_AWARE"]
# ------------------------------------------------------------ end fixed values

ALL_STATES = sorted(set(STATE_SPELLINGS.values()))
FOREST_SEASONS = ["Kharif", "Rabi", "Zaid"]
