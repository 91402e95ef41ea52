"""mnemoframe: DataFrame-native analytics over long-lived text memories and their logs."""

__version__ = "0.1.0"
