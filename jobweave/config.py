"""Rule tables and thresholds that operators take as defaults; every one is a parameter."""

from __future__ import annotations

# Classifier lexicons, in the order that reasons list them.
INCLUDE_TERMS = (
    "political", "IR", "international relations", "governance", "policy", "peace", "conflict", "election", "civic",
    "democracy", "human rights", "diplomacy", "advocacy", "civil society", "social science", "sociology", "anthropology",
    "development studies", "public administration", "public policy", "gender", "women's rights", "refugees", "migration",
    "peacebuilding",
)
EXCLUDE_TERMS = (
    "health", "medical", "nutrition", "WASH", "livestock", "agriculture", "veterinary", "accountant", "finance officer",
    "engineering", "mechanic", "supply chain", "logistics officer", "driver", "IT support", "network admin", "sales",
)
HIGH_SIGNAL_TERMS = (
    "governance", "human rights", "election", "democracy", "peacebuilding", "international relations", "public policy", "policy",
)
TAG_TERMS = {
    "governance": ("governance", "public administration"),
    "human-rights": ("human rights", "rights"),
    "peace-conflict": ("peace", "conflict", "peacebuilding"),
    "elections-democracy": ("election", "democracy", "civic"),
    "policy": ("policy", "public policy"),
    "international-relations": ("international relations", "diplomacy", "IR"),
    "gender": ("gender", "women's rights", "women rights"),
    "migration-refugees": ("migration", "refugees", "refugee"),
    "civil-society": ("civil society", "cso"),
    "development-studies": ("development studies", "development"),
    "sociology": ("sociology", "social science", "anthropology"),
    "advocacy-comms": ("advocacy", "communications", "campaign"),
    "digital-rights": ("digital rights", "internet freedom", "online safety"),
}

# Vocabularies of the tables.
PRIORITIES = ("critical", "high", "medium", "low")
STATUSES = ("active", "expired", "hidden")
ORG_CATEGORIES = (
    "un", "au", "regional", "think-tank", "human-rights-intl", "human-rights-eth", "election-democracy", "ingo", "bilateral",
    "embassy", "foundation", "multilateral", "gender", "climate", "media", "digital-rights", "government-eth", "aggregator", "other",
)
DOMESTIC_SOURCES = ("ethiongojobs", "ehrdc", "undp")

# Thresholds.
SHOW_FIT, CHANNEL_FIT, BULLSEYE_FIT = 50, 70, 90
UNDATED_STALE_DAYS = 120
DUPLICATE_SIMILARITY = 0.5
LOCAL_ZONE = "Africa/Addis_Ababa"
