"""A PySpark-native engine for asset-price panels: features, formulas, scoring, ledgers."""
