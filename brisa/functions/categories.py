"""Categories, advisories and alerts of an air-quality value.

The cut points and texts are fixed values. Everything is an expression over
literals, so a category costs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Health categories, cut at <= 1, 2, 3, 4.
HEALTH_CATEGORIES = ["Good", "Moderate", "Unhealthy (Sensitive)", "Unhealthy", "Hazardous"]

# Status, colour, description and recommendations, cut at <= 1, 2, 3, 4.
STATUS = [
    {
        "status": "Good",
        "color": "green",
        "description": "Air quality is satisfactory, and air pollution poses little or no risk.",
        "recommendations": ["Enjoy outdoor activities", "No special precautions needed"],
    },
    {
        "status": "Fair",
        "color": "yellow",
        "description": "Air quality is acceptable. However, there may be a risk for some people.",
        "recommendations": ["Sensitive individuals should consider limiting prolonged outdoor exertion"],
    },
    {
        "status": "Moderate",
        "color": "orange",
        "description": "Members of sensitive groups may experience health effects.",
        "recommendations": [
            "Children and the elderly should limit prolonged outdoor exertion",
            "People with respiratory disease should avoid prolonged outdoor exertion",
        ],
    },
    {
        "status": "Poor",
        "color": "red",
        "description": "Everyone may begin to experience health effects.",
        "recommendations": [
            "Avoid prolonged outdoor exertion",
            "Consider rescheduling outdoor activities",
            "People with respiratory disease should avoid outdoor exertion",
        ],
    },
    {
        "status": "Very Poor",
        "color": "darkred",
        "description": "Emergency conditions. The entire population is more likely to be affected.",
        "recommendations": [
            "Avoid all outdoor activities",
            "Stay indoors with windows closed",
            "Use air purifiers if available",
            "Wear N95 masks if going outside is necessary",
        ],
    },
]

# Gauge label, colour and needle score, cut at <= 1, 2, 3, 4.
GAUGE = [
    {"label": "🟢 Good", "color": "green", "score": 0.2},
    {"label": "🟡 Fair", "color": "orange", "score": 0.4},
    {"label": "🟠 Moderate", "color": "orange", "score": 0.6},
    {"label": "🔴 Poor", "color": "red", "score": 0.8},
    {"label": "☠️ Very Poor", "color": "darkred", "score": 1.0},
]

# Cell styles of the forecast table, cut at <= 2, 3, 4.
SEVERITY_STYLES = [
    "background-color: #d4edda; color: #155724;",
    "background-color: #fff3cd; color: #856404;",
    "background-color: #f8d7da; color: #721c24;",
    "background-color: #721c24; color: white;",
]

# Current advisory per category.
ADVISORY = [
    {
        "title": "GOOD AIR QUALITY",
        "impacts": ["Clean, healthy air", "No health concerns"],
        "actions": ["Perfect for outdoor activities", "No restrictions needed", "Enjoy fresh air"],
    },
    {
        "title": "FAIR AIR QUALITY",
        "impacts": ["Acceptable air quality", "Minor impact on sensitive groups"],
        "actions": ["No restrictions needed", "Good for outdoor activities", "Normal daily routines"],
    },
    {
        "title": "MODERATE AIR QUALITY",
        "impacts": [
            "Moderate air pollution",
            "Uncomfortable for sensitive individuals",
            "Possible respiratory irritation",
        ],
        "actions": [
            "Generally safe for most people",
            "Sensitive individuals should consider reducing activity",
            "Good air circulation indoors",
        ],
    },
    {
        "title": "POOR AIR QUALITY",
        "impacts": [
            "High air pollution levels",
            "Aggravation of respiratory conditions",
            "Reduced lung function",
            "Increased risk for heart disease",
        ],
        "actions": [
            "Reduce outdoor activities",
            "Close windows during peak hours",
            "Use air conditioning if available",
            "Limit physical exertion outdoors",
        ],
    },
    {
        "title": "VERY POOR AIR QUALITY",
        "impacts": [
            "Severe air pollution",
            "Significant health risks",
            "Respiratory problems",
            "Cardiovascular effects",
        ],
        "actions": [
            "Avoid all outdoor activities",
            "Keep windows and doors closed",
            "Use air purifiers with HEPA filters",
            "Wear N95 masks if going outside",
            "Sensitive groups stay indoors",
        ],
    },
]

# Planning advice for the highest forecast value, cut at <= 1, 2, 3, 4.
PLANNING = [
    {
        "headline": "Favorable Forecast: Good air quality expected",
        "advice": [
            "Perfect for outdoor activities",
            "No special precautions needed",
            "Enjoy outdoor recreation",
        ],
    },
    {
        "headline": "Favorable Forecast: Fair air quality expected",
        "advice": [
            "Suitable for all outdoor activities",
            "No special precautions needed",
            "Enjoy outdoor recreation",
        ],
    },
    {
        "headline": "Moderate Alert: Moderate air quality expected",
        "advice": [
            "Generally acceptable for most activities",
            "Sensitive individuals should take precautions",
            "Good indoor air circulation recommended",
        ],
    },
    {
        "headline": "Caution: Poor air quality expected",
        "advice": [
            "Limit prolonged outdoor activities",
            "Keep windows closed during peak pollution",
            "Use air purifiers indoors",
            "Consider rescheduling outdoor events",
        ],
    },
    {
        "headline": "Critical Alert: Very Poor air quality forecasted",
        "advice": [
            "Avoid all outdoor activities",
            "Prepare indoor air filtration",
            "Stock up on N95 masks",
            "Monitor health advisories closely",
        ],
    },
]

# Alert thresholds, reached with >=, highest first.
ALERT_THRESHOLDS = [
    ("hazardous", 5.0),
    ("unhealthy", 4.0),
    ("unhealthy_sensitive", 3.0),
    ("moderate", 2.0),
]

# Alert texts per level.
ALERTS = {
    "hazardous": {
        "title": "🚨 HAZARDOUS AIR QUALITY ALERT 🚨",
        "mark": "⚠️",
        "impacts": [
            "Serious respiratory effects",
            "Aggravation of heart/lung diseases",
            "Risk of premature death",
        ],
        "actions": [
            "Avoid all outdoor activities",
            "Keep windows and doors closed",
            "Use air purifiers",
            "Sensitive groups stay indoors",
            "Follow local health advisories",
        ],
        "closing": "This is a health emergency. Take immediate precautions.",
    },
    "unhealthy": {
        "title": "🔴 UNHEALTHY AIR QUALITY ALERT",
        "mark": "⚠️",
        "impacts": [
            "Breathing discomfort for everyone",
            "Aggravation of respiratory conditions",
            "Increased risk for sensitive groups",
        ],
        "actions": [
            "Avoid prolonged outdoor exertion",
            "People with respiratory issues should stay indoors",
            "Close windows during peak pollution hours",
            "Consider rescheduling outdoor activities",
        ],
        "closing": "Monitor air quality and limit exposure.",
    },
    "unhealthy_sensitive": {
        "title": "🟠 UNHEALTHY FOR SENSITIVE GROUPS ALERT",
        "mark": "⚠️",
        "impacts": [
            "May affect sensitive individuals",
            "Children and elderly at higher risk",
            "People with respiratory diseases affected",
        ],
        "actions": [
            "Sensitive groups should limit outdoor activities",
            "Reduce prolonged exertion outdoors",
            "Monitor symptoms closely",
            "Consider indoor alternatives",
        ],
        "closing": "Generally safe for most healthy adults.",
    },
    "moderate": {
        "title": "🟡 MODERATE AIR QUALITY ALERT",
        "mark": "ℹ️",
        "impacts": [
            "Acceptable air quality for most people",
            "May affect very sensitive individuals",
        ],
        "actions": [
            "Unusually sensitive people should consider limiting prolonged outdoor exertion",
            "Generally safe for outdoor activities",
        ],
        "closing": "No major restrictions needed.",
    },
}

# The alert of a value that is none.
UNKNOWN_ALERT = "Unknown alert level"


def _text(value):
    """A Python text, number or list of texts as a literal column."""
    if isinstance(value, list):
        return F.array(*[F.lit(item) for item in value])
    return F.lit(value)


def by_cut(value: Column, cuts: list[float], results: list) -> Column:
    """``results[i]`` for the first cut with ``value <= cut``, else the last result."""
    chain = F.when(value.isNull(), F.lit(None))
    for cut, result in zip(cuts, results):
        chain = chain.when(value <= cut, _text(result))
    return chain.otherwise(_text(results[-1]))


def _five_way(value: Column, results: list) -> Column:
    return by_cut(value, [1.0, 2.0, 3.0, 4.0], results)


def category_rank(value: Column) -> Column:
    """Position 1 to 5 of the category."""
    return _five_way(value, [1, 2, 3, 4, 5])


def health_category(value: Column) -> Column:
    return _five_way(value, HEALTH_CATEGORIES)


def status_fields(value: Column) -> dict[str, Column]:
    """Status, colour, description and the list of recommendations."""
    return {name: _five_way(value, [row[name] for row in STATUS]) for name in STATUS[0]}


def gauge_fields(value: Column) -> dict[str, Column]:
    return {name: _five_way(value, [row[name] for row in GAUGE]) for name in GAUGE[0]}


def gauge_level(value: Column) -> Column:
    """Ceiling, held between 1 and 5."""
    return F.least(F.greatest(F.ceil(value), F.lit(1)), F.lit(5)).cast("int")


def severity_band(value: Column) -> Column:
    """Band 1 to 4 of a forecast table cell."""
    return by_cut(value, [2.0, 3.0, 4.0], [1, 2, 3, 4])


def severity_style(value: Column) -> Column:
    return by_cut(value, [2.0, 3.0, 4.0], SEVERITY_STYLES)


def advisory_fields(value: Column) -> dict[str, Column]:
    fields = {name: _five_way(value, [row[name] for row in ADVISORY]) for name in ADVISORY[0]}
    fields["advisory"] = F.concat_ws(
        "\n",
        fields["title"],
        F.format_string("AQI: %.2f", value),
        F.lit("Health Impacts:"),
        _bullets(fields["impacts"]),
        F.lit("Recommended Actions:"),
        _bullets(fields["actions"]),
    )
    return fields


def planning_fields(value: Column) -> dict[str, Column]:
    return {name: _five_way(value, [row[name] for row in PLANNING]) for name in PLANNING[0]}


def alert_level(value: Column) -> Column:
    chain = F.when(value.isNull(), F.lit(None))
    for level, threshold in ALERT_THRESHOLDS:
        chain = chain.when(value >= threshold, level)
    return chain.otherwise("good")


def should_alert(value: Column) -> Column:
    return value >= ALERT_THRESHOLDS[-1][1]


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("• "), item)), "\n")


def alert_subject(level: Column, location: Column) -> Column:
    return F.concat(F.lit("AQI Alert: "), F.upper(level), F.lit(" - "), location)


def alert_message(level: Column, location: Column, value: Column, time: Column) -> Column:
    """Body text of an alert. The time is the reading's, so a rerun gives the same text."""
    chain = None
    for name, parts in ALERTS.items():
        body = F.concat_ws(
            "\n",
            F.lit(parts["title"]),
            F.lit(""),
            F.concat(F.lit("Location: "), location),
            F.format_string("AQI: %.2f", value),
            F.concat(F.lit("Time: "), F.date_format(time, "yyyy-MM-dd HH:mm:ss")),
            F.lit(""),
            F.lit(f"{parts['mark']} HEALTH IMPACTS:"),
            *[F.lit(f"• {item}") for item in parts["impacts"]],
            F.lit(""),
            F.lit("🛡️ RECOMMENDED ACTIONS:"),
            *[F.lit(f"• {item}") for item in parts["actions"]],
            F.lit(""),
            F.lit(parts["closing"]),
        )
        chain = F.when(level == name, body) if chain is None else chain.when(level == name, body)
    return chain.otherwise(UNKNOWN_ALERT)
