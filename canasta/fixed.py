"""Column names, default thresholds and labels.

Everything in this module is a fixed value: results are only right when these
agree with the published marts, so they are stated here once, as plain text.
"""

# ---- input layout -----------------------------------------------------------
FIELD_SEPARATOR = "|"
TRANSACTION_FILES = "*_Tran.csv"
DATE_PATTERN = "yyyy-MM-dd"
RAW_COLUMNS = ["date", "store_id", "client_id", "items_str"]
CATEGORY_SCHEMA = "category_id INT, category_name STRING"
PRODUCT_CATEGORY_COLUMNS = ["product_code", "category_id"]
UNKNOWN_CATEGORY_PREFIX = "Categoría "

# ---- calendar labels (0 = Monday) -------------------------------------------
WEEKDAYS_ES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]
WEEKDAYS_ES_SHORT = ["Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom"]

# ---- distribution labels ----------------------------------------------------
BASKET_SIZE_LABEL = "Tamaño de cesta"
CLIENT_TOTAL_LABEL = "Total unidades por cliente"
REMAINDER_LABEL = "Otros"

# ---- client features --------------------------------------------------------
FEATURES = [
    "purchase_frequency",
    "total_units",
    "avg_basket_size",
    "avg_categories_per_txn",
    "category_diversity",
    "num_stores_visited",
    "active_days",
]
FEATURE_LABELS_ES = [
    "Frecuencia de compra",
    "Total unidades",
    "Promedio cesta",
    "Categorías por transacción",
    "Diversidad de categorías",
    "Tiendas visitadas",
    "Días activos",
]
SEGMENT_FEATURES = [
    "purchase_frequency",
    "total_units",
    "avg_basket_size",
    "category_diversity",
    "active_days",
]

# ---- segment labels ---------------------------------------------------------
SPORADIC = "Compradores Esporádicos"
OCCASIONAL = "Compradores Ocasionales"
DIVERSIFIED = "Compradores Diversificados"
VIP = "Compradores VIP"
REGULAR = "Compradores Regulares"

# ---- report sizes and thresholds --------------------------------------------
TOP_N = 10
OUTLIER_TOP_N = 20
IQR_FACTOR = 1.5
HISTOGRAM_SHOWN = 30
TOP_FREQUENT_CATEGORIES = 15
PIE_SLICES = 9
FEATURE_SAMPLE = 500
SEED = 42

K_VALUES = [3, 4, 5, 6]
KMEANS_STARTS = 10
KMEANS_ITERATIONS = 300
SEGMENT_SAMPLE = 2000
SILHOUETTE_SAMPLE = 15_000
SEGMENT_TOP_CATEGORIES = 10

MIN_SUPPORT = 0.05
MIN_CONFIDENCE = 0.30
MIN_LIFT = 1.0
INDEX_PER_CATEGORY = 15
MAX_RULES = 1000
OVERVIEW_ROWS = 30
RECOMMENDATIONS_PER_CLIENT = 20
SUGGESTIONS_SHOWN = 8
LIFT_BANDS = [3.0, 2.0, 1.5]

RUN_HISTORY = 20
