"""Analytics over agent and investigation traces, written as Spark DataFrame plans."""
