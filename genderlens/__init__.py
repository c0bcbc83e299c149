"""genderlens: Spark-native measurement of how text classifiers treat
counterfactual (male / female / neutral) versions of the same documents."""

__version__ = "0.1.0"
