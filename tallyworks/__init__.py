"""tallyworks: a Spark-native engine for cited-fact corpora and open-data ledgers."""
