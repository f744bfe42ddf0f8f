"""Label ontologies, keyword clusters and token lists.

Everything here is data that decides results, written out plainly. The
operators take all of it as arguments; these are only the defaults.
"""

from __future__ import annotations

OTHER = "OTHER"
UNCLUSTERED = "Unclustered"
NOT_IN_ONTOLOGY = "❓ Not in ontology"

# Canonical code -> (label, aliases). Aliases are compared after
# trimming and lower-casing; an alias listed twice belongs to the later code.
ASPECT_ONTOLOGY = {
    "E": ("Environmental", ["E", "ENV", "environment", "environmental", "ECONOMIC"]),
    "S": ("Social", ["S", "SOC", "social"]),
    "G": ("Governance", ["G", "GOV", "governance", "G>"]),
    "E-S": ("Environmental & Social", ["E-S", "S-E", "ES", "E S", "E/S"]),
    "E-G": ("Environmental & Governance", ["E-G", "G-E", "EG", "E G"]),
    "S-G": ("Social & Governance", ["S-G", "G-S", "SG", "S G"]),
    "E-S-G": ("Environmental, Social & Governance", ["ESG", "E-S-G", "E S G", "E,S,G"]),
    "OTHER": ("Other / Unclassified", ["none", "unknown", "", None, "OTHER", "W", "GRI305"]),
}
SENTIMENT_ONTOLOGY = {
    "POSITIVE": ("Positive", ["positive", "positif", "Positive", "POS", "good", "favorable"]),
    "NEUTRAL": ("Neutral", ["neutral", "Neutral", "neural", "none", "commitment", "mixed"]),
    "NEGATIVE": ("Negative", ["negative", "Negative", "NEG", "bad", "unfavorable"]),
    "OTHER": ("Other / Unclassified", ["", None, "unknown", "na", "none"]),
}
TONE_ONTOLOGY = {
    "OUTCOME": ("Outcome", ["outcome", "achievement", "result", "impact", "success"]),
    "ACTION": ("Action", ["action", "initiative", "implementation", "execution"]),
    "COMMITMENT": ("Commitment", ["commitment", "commit", "pledge", "promise"]),
    "OTHER": ("Other / Unclassified", ["challenge", "compliance", "neutral", "", None, "unknown"]),
}

# The short cluster table (cluster -> keywords, in priority order).
SIX_CLUSTERS = {
    "Governance": ["governance", "corporate governance", "board oversight", "management oversight"],
    "Emissions": [
        "emissions", "carbon", "carbon footprint", "ghg", "greenhouse gas",
        "scope 1", "scope 2", "scope 3",
    ],
    "Financial Reporting": [
        "financial reporting", "financial performance", "financial disclosure", "financial",
    ],
    "Climate & Energy": ["energy", "renewable energy", "energy efficiency", "energy transition"],
    "Community & Social Impact": ["stakeholder engagement", "community", "social impact"],
    "Tax & Compliance": ["tax", "taxation", "compliance"],
}

# The long cluster table (cluster -> keywords), in priority order. Keywords
# are compared as they stand with the lower-cased aspect, so those with capitals count
# only where keywords are folded too; repeats change nothing.
CLUSTERS = {
    "Governance & Board": [
        "governance", "board", "board of directors", "board of commissioners",
        "board composition", "board independence", "board diversity",
        "leadership", "executive", "committee", "oversight",
        "corporate governance", "management oversight",
        "governance", "board", "board composition", "board structure",
        "shareholder", "shareholding", "shareholder structure",
        "corporate actions", "ipo", "listing",
        "general meeting", "share ownership",
        "corporate structure", "organization structure",
        "subsidiaries", "related parties", "related party transactions",
        "remuneration", "remuneration policy",
        "voter participation", "succession planning",
        "company", "company name", "affiliation",
        "stakeholder engagement",
        "Stakeholders",
        "Good Corporate Governance implementation",
        "ultimate beneficial ownership",
        "Board of Directors performance",
        "nomination and selection process compliance",
        "succession program",
        "stakeholder communication",
        "stakeholder relations",
        "corporate governance",
        "organizational hierarchy",
        "stakeholder feedback",
        "stakeholder identification",
        "successor development",
        "ultimate beneficial ownership",
    ],
    "Risk Management & Internal Control": [
        "risk", "risk management", "risk assessment", "risk mitigation",
        "internal control", "internal audit", "control system",
        "compliance risk", "legal risk", "liquidity risk", "credit risk",
        "compliance",
        "legal compliance",
        "manajemen risiko",
        "internal controls",
        "regulatory compliance",
        "emergency preparedness",
        "emergency response",
        "audit processes",
        "legal and regulatory compliance",
        "legal exposure",
        "risk management",
        "internal control system",
        "integrated risk management",
        "early warning system",
    ],
    "Ethics, Integrity & Anti-Corruption": [
        "ethics", "integrity", "anti-corruption", "anti bribery",
        "whistleblowing", "conflict of interest", "fraud",
        "business ethics", "transparency", "code of conduct",
    ],
    "Emissions & Climate": [
        "emission", "carbon", "ghg", "greenhouse gas",
        "scope 1", "scope 2", "scope 3",
        "climate change", "net zero", "decarbonization",
        "methane", "flaring",
    ],
    "Energy": [
        "energy", "renewable", "energy efficiency",
        "biofuel", "hydrogen", "electricity",
        "clean fuel", "energy transition",
    ],
    "Water & Waste": [
        "water", "water consumption", "water withdrawal",
        "water recycling", "waste", "waste management",
        "hazardous waste", "waste reduction", "recycling",
        "spill incidents",
        "oil spill incidents",
        "water management",
        "waste management",
        "water consumption",
        "water recycling",
        "hazardous waste management",
        "water discharge",
        "clean water access",
        "wastewater discharge",
        "circular economy",
        "produced water",
        "oil spill management",
        "oil spill prevention",
        "effluent management",
        "effluent reduction",
        "water withdrawal",
        "produced water handling and reinjection",
        "waste reduction via 3R",
        "hazardous waste generation",
        "water use reduction",
        "wastewater treatment",
        "hazardous waste recycling",
    ],
    "Biodiversity & Environmental Impact": [
        "biodiversity", "ecosystem", "environmental impact",
        "environmental footprint", "conservation",
        "rehabilitation", "land use", "habitat", " Environment", "E",
        "wildlife release",
        "tree planting and forest restoration",
        "buffer zone expansion and compliance",
        "HCV assessments (High Conservation Value)",
        "forest management and restoration",
        "mangrove planting impact",
        "coral reef restoration and turtle release",
        "protected species impact and count",
        "nature-based solutions (NBS)",
        "environmental protection and reclamation",
        "reserves in protected or conflict areas",
        "whale shark population count",
    ],
    "Human Capital & Workforce": [
        "employees", "workforce", "human capital",
        "training", "education", "talent", "skills",
        "employee development", "employee engagement",
    ],
    "Health, Safety & Well-being": [
        "health", "safety", "occupational health",
        "workplace safety", "accident", "injury",
        "ohs", "hsse", "well-being",
    ],
    "Diversity, Equity & Inclusion": [
        "diversity", "inclusion", "gender",
        "equal opportunity", "gender equality",
        "pay equity", "women", "minority",
    ],
    "Human Rights & Labor Practices": [
        "human rights", "child labor", "forced labor",
        "labor practices", "freedom of association",
        "fair labor", "worker rights",
    ],
    "Community & Social Impact": [
        "community", "csr", "social responsibility",
        "social impact", "education", "healthcare",
        "local community", "public health", "social performance", "Social",
    ],
    "Supply Chain & Procurement": [
        "supply chain", "supplier", "procurement",
        "sourcing", "traceability",
        "supplier sustainability", "local supplier",
    ],
    "Customers & Product Responsibility": [
        "customer", "customer satisfaction",
        "product safety", "product quality",
        "service quality", "consumer protection",
    ],
    "Sustainability Strategy & ESG": [
        "sustainability", "esg", "sustainability strategy",
        "sustainable development", "sdgs",
        "sustainability roadmap", "sustainability policy",
        "sustainable finance",
        "SDG alignment",
        "ESG performance",
        "sustainable bond issuance",
        "Material Topic Management",
        "sustainable business practices",
        "sustainable building practices",
        "sustainable finance performance",
        "sustainable research center",
        "SDG contribution",
        "PROPER Emas certification",
    ],
    "Reporting, Disclosure & Assurance": [
        "reporting", "disclosure", "sustainability report",
        "assurance", "verification", "audit opinion",
        "report quality", "materiality",
    ],
    "Financial Performance & Capital": [
        "revenue", "profit", "profitability",
        "capital", "assets", "liabilities",
        "cash flow", "equity", "investment", "financial", "financial performance",
        "financial instruments", "economic performance",
        "taxation",
        "tax",
        "financing",
        "finance",
        "sustainable bonds",
        "green bond issuance",
        "cash and cash equivalents",
        "earnings per share",
        "dividends",
        "payables",
        "net sales",
        "capital structure",
        "gearing ratio",
        "tax compliance",
        "tax contribution",
        "tax assessment",
        "tax management",
        "dividend policy",
        "cash management",
        "debt instruments",
        "funding",
        "loans",
        "bond issuance",
        "tax strategy",
    ],
    "Business Strategy & Operations": [
        "operations", "business strategy",
        "growth", "innovation", "digital transformation",
        "operational efficiency", "infrastructure",
        "corporate strategy and strategic direction",
        "business expansion and international expansion",
        "operational disruption and impact management",
        "business model and business diversification",
        "strategic partnerships and collaboration",
        "asset management and identification",
        "market share and market presence",
        "brand transformation and rebranding",
        "operational effectiveness and efficiency",
        "product development and launch",
    ],
    "Digital & Data Security": [
        "digital", "cyber", "data security",
        "information security", "it", "technology",
        "privacy", "digital transformation",
    ],
}

# Texts a CSV field may hold in place of a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Labels that count as "no label" in an evaluation (lower-cased).
INVALID_LABELS = ["nan", "none", "", "null"]

# Characters removed from both ends of a label, i.e. every code point
# that is white space in Unicode or one of the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Class order of the two heads of the scoring models.
SENTIMENT_CLASSES = ["positive", "neutral", "negative", "none"]
TONE_CLASSES = ["Action", "Commitment", "Outcome"]

# Columns an annotation object may carry, with their Spark types.
ANNOTATION_FIELDS = {
    "sentence": "string",
    "aspect": "string",
    "aspect_category": "string",
    "sentiment": "string",
    "sentiment_score": "double",
    "tone": "string",
    "materiality": "string",
    "stakeholder": "string",
    "impact_level": "string",
    "time_horizon": "string",
    "value_chain_stage": "string",
    "confidence": "double",
    "ontology_uri": "string",
}
