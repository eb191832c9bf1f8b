"""graftline.functions"""
