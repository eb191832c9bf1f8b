"""graftline.streaming"""
