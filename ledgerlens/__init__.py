"""ledgerlens: payment-fraud investigation analytics as Spark DataFrame operators."""
