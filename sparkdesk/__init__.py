"""Analytics over the data an AI-assistant workspace leaves behind, on Spark."""
