"""Supply-chain cost analytics on Spark: rate cards, cost roll-ups, service mix, KPIs and checks."""
