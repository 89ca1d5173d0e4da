"""The price list used to cost events, and its later revisions.

Fixed values: rates per million tokens (ai) or per unit (image, search).
"""

PRICE_LIST = """{
  "version": "2026-10-19", "collected": "2026-10-19", "display_currency": "EUR",
  "fx": {"EUR": 1.0, "USD": 0.92},
  "sources": {
    "scaleway": "https://www.scaleway.com/en/pricing/model-as-a-service/",
    "bfl": "https://bfl.ai/pricing",
    "ovh": "https://www.ovhcloud.com/en/public-cloud/ai-endpoints/",
    "linkup": "https://www.linkup.so/",
    "staan": "https://staan.ai/",
    "fx": "https://www.ecb.europa.eu/stats/policy_and_exchange_rates/euro_reference_exchange_rates/html/index.en.html"
  },
  "free": {"bfl": "none", "staan": "1,000 searches/month", "searxng": "free (self-hosted)"},
  "ai": {
    "default": {"input_per_mtok": 1.80, "output_per_mtok": 5.50, "currency": "EUR"},
    "glm-5.3": {"input_per_mtok": 1.80, "output_per_mtok": 5.50, "currency": "EUR"},
    "glm-5.2": {"input_per_mtok": 1.80, "output_per_mtok": 5.50, "currency": "EUR"},
    "mistral-small-3.2-24b-instruct-2506": {"input_per_mtok": 0.15, "output_per_mtok": 0.35, "currency": "EUR"}
  },
  "image": {
    "default": {"per_unit": 0.04, "currency": "USD"},
    "flux-pro-1.1": {"per_unit": 0.04, "currency": "USD"},
    "flux-pro-1.1-ultra": {"per_unit": 0.06, "currency": "USD"},
    "flux-pro": {"per_unit": 0.05, "currency": "USD"},
    "flux-kontext-pro": {"per_unit": 0.04, "currency": "USD"},
    "flux-kontext-max": {"per_unit": 0.08, "currency": "USD"},
    "flux-2-pro": {"per_unit": 0.03, "currency": "USD"},
    "flux-2-max": {"per_unit": 0.07, "currency": "USD"},
    "flux-2-flex": {"per_unit": 0.05, "currency": "USD"},
    "flux-2-klein-9b": {"per_unit": 0.015, "currency": "USD"},
    "flux-2-klein-4b": {"per_unit": 0.014, "currency": "USD"},
    "ovh-sdxl": {"per_unit": 0.004, "currency": "EUR"},
    "custom": {"per_unit": 0.0, "currency": "EUR"}
  },
  "search": {
    "default": {"per_unit": 0.0, "currency": "EUR"},
    "linkup": {"per_unit": 0.005, "currency": "USD"},
    "staan": {"per_unit": 0.001, "currency": "EUR"},
    "searxng": {"per_unit": 0.0, "currency": "EUR"}
  }
}"""

# when each revision was collected, and its rates relative to the list above
REVISIONS = [("1995-06-01", 1.0), ("1998-01-01", 1.1), ("2000-06-01", 1.25)]

PROVIDER_NAMES = [
    ("image", "ovh", "OVHcloud"),
    ("image", "bfl", "Black Forest Labs"),
    ("image", "custom", "Custom"),
    ("search", "linkup", "Linkup"),
    ("search", "staan", "Qwant Staan"),
    ("search", "searxng", "SearXNG"),
]

KNOWN_CURRENCIES = ["EUR", "USD", "GBP", "DKK", "SEK", "NOK", "CHF", "PLN"]
MAX_PLAUSIBLE_RATE = 10_000.0
MAX_PRICE_FILE_BYTES = 256 * 1024
