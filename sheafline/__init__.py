"""sheafline: a Spark-native engine for receipt-document analytics."""
