"""What is to be checked: specification, rules, settings, pre-flight. No Spark job runs here."""
