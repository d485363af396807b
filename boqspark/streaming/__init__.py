"""boqspark.streaming"""
