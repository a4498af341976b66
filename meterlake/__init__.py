"""meterlake: usage-metering analytics and corpus preparation on PySpark."""
