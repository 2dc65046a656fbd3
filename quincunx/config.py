"""Constants of the scoring model."""

# Fixed values of the model: divisors of the features, and risks of merchant categories.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_VS_AVG, MAX_MINUTES, MAX_KM, MAX_TX_COUNT, MAX_MERCHANT_AVG = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0, 10000.0
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.5

DIM = 14
NEIGHBOURS = 5
QUICK_PROBES, EXPANDED_PROBES, MOST_PROBES = 8, 20, 32
SCALE = 10_000  # of stored vectors
FINE = 100_000_000  # of unquantized queries, as integers
BLOCK = 16
KNOWN_MERCHANTS = 32
# Names of the last six features.
TAIL_NAMES = ("tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg")
