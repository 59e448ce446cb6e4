"""Fixed display dimensions of the published page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCT_PREFIX = "Financiamentos"
GENERAL_LABEL = "Financiamentos (geral)"

# The 27 entity codes, their names and their place in the grid map
# (code, name, column, row).
ENTITIES = [
    ("AC", "Acre", 1, 3),
    ("AL", "Alagoas", 6, 4),
    ("AM", "Amazonas", 2, 2),
    ("AP", "Amapá", 4, 1),
    ("BA", "Bahia", 4, 4),
    ("CE", "Ceará", 5, 2),
    ("DF", "Distrito Federal", 3, 5),
    ("ES", "Espírito Santo", 5, 5),
    ("GO", "Goiás", 3, 4),
    ("MA", "Maranhão", 4, 2),
    ("MG", "Minas Gerais", 4, 5),
    ("MS", "Mato Grosso do Sul", 2, 5),
    ("MT", "Mato Grosso", 2, 4),
    ("PA", "Pará", 3, 2),
    ("PB", "Paraíba", 6, 3),
    ("PE", "Pernambuco", 5, 3),
    ("PI", "Piauí", 4, 3),
    ("PR", "Paraná", 2, 6),
    ("RJ", "Rio de Janeiro", 4, 6),
    ("RN", "Rio Grande do Norte", 6, 2),
    ("RO", "Rondônia", 2, 3),
    ("RR", "Roraima", 2, 1),
    ("RS", "Rio Grande do Sul", 2, 8),
    ("SC", "Santa Catarina", 2, 7),
    ("SE", "Sergipe", 5, 4),
    ("SP", "São Paulo", 3, 6),
    ("TO", "Tocantins", 3, 3),
]
ENTITY_CODES = tuple(code for code, *_ in ENTITIES)

# Known products in display order
# (position, key, fragment of the plain lower-case name, name, short name).
# The general product has no fragment: its name is the bare prefix.
PRODUCTS = [
    (1, "imobiliario", "imobiliario", "Imobiliário", "Imob."),
    (2, "rural", "rura", "Rural", "Rural"),
    (3, "geral", "", "Financiamentos (geral)", "Fin. geral"),
    (4, "exportacao", "exportacao", "Exportação", "Export."),
    (5, "interveniencia", "interveniencia", "Com interveniência", "Interv."),
    (6, "infraestrutura", "infraestrutura", "Infraestrutura e desenvolvimento", "Infra."),
    (7, "titulos", "titulos", "Títulos e valores mobiliários", "Títulos"),
    (8, "importacao", "importacao", "Importação", "Import."),
]


def entity_dimension(spark: SparkSession) -> DataFrame:
    """J20. 27 rows."""
    return spark.createDataFrame(ENTITIES, "entity string, entity_name string, grid_column int, grid_row int")


def product_dimension(spark: SparkSession) -> DataFrame:
    """J18. 8 rows."""
    return spark.createDataFrame(
        PRODUCTS, "position int, product_key string, fragment string, name string, short_name string"
    )
