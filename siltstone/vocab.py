"""Controlled vocabularies."""

# Names and orders that results depend on.
SOURCE_PRIORITY = ["eurostat", "uic", "ksh", "statistik_austria", "worldbank"]
SENTIMENT_SCORE = {"negative": -1.0, "neutral": 0.0, "positive": 1.0}
LANGUAGES = ["hu", "de", "en", "fr", "es", "it", "pl", "ro", "sk", "cs"]
LANGUAGE_ALIASES = {"cz": "cs"}
EVENT_TYPES = ["investment", "accident", "strike", "service_change", "policy", "line_opening", "line_closure", "delay", "financial", "other"]
OPERATORS = ["MÁV", "GYSEV", "ÖBB", "Westbahn", "RailCargo", "other"]
OPERATOR_ALIASES = {"MÁV": ["mav", "hungarian railways"], "GYSEV": ["gysev", "raaberbahn"], "ÖBB": ["obb", "oebb"], "Westbahn": ["westbahn"], "RailCargo": ["railcargo", "rail cargo"]}
THEME_RULES = [
    ("accident", ["RAIL_INCIDENT", "DERAIL", "ACCIDENT", "DISASTER"]),
    ("strike", ["LABOR_STRIKE", "STRIKE", "PROTEST"]),
    ("investment", ["ECON_INVESTMENT", "INVESTMENT", "INFRASTRUCTURE"]),
    ("delay", ["DELAY", "DISRUPTION", "CANCEL"]),
    ("service_change", ["PUBLIC_TRANSPORT", "RAIL_TRANSPORT", "TRANSPORT"]),
]
SUPERCLASS = {
    "accident": "disruption", "strike": "disruption", "service_change": "disruption", "delay": "disruption", "line_closure": "disruption",
    "investment": "development", "line_opening": "development", "financial": "development", "policy": "policy", "other": "other",
}
HOME_COUNTRIES = ["HU", "AT"]
GKG_FIELDS = ["themes", "persons", "organizations", "locations", "emotions"]
# The two-letter language codes of ISO 639-1.
LANGUAGE_CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz "
    "ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl "
    "ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
