"""Text geolocation and corpus analytics on Spark DataFrames."""
